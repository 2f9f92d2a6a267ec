"""Licence scans with a trained paragraph classifier.

A paragraph (a line of the text) is a set of word one-, two- and three-grams. Those of the licence templates that hold a
word with some meaning are the features; a sparse (elastic net) multinomial logistic regression over them tells the
families and `unknown`. It is trained on pieces of the templates against sentences that only sound like licences and all
lines of the corpus that hold no three words of a template. Lines with the same features are one training row, weighted by
how many different lines it stands for; together lines weigh at most as much as the pieces. The probability a family needs
is calibrated on the fifth of these lines and sentences that is held back: at most 1% of it may exceed it. A prediction is
confirmed by comparison with the templates of its family: enough of the paragraph's word pairs must occur there.

A notice inside a longer line is found by its words: for each family, the runs of words of which enough pairs are the
family's (`matching_runs`) and that hold half of a template, or as many pairs as the longest training piece, are classified
apart from the words around them. Of runs that overlap, those with the most pairs count. The whole line is one more run.

Only DataFrame operations and spark.ml. A paragraph without any feature word has no feature and is unknown for certain, and
one that can't be confirmed as a whole (`could_be_confirmed`) nor in any run (`has_run`) is left out before n-grams are
made; documents are not shuffled as long as nothing is found in them.
"""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.license_texts import FUNCTION_WORDS, OTHER, TEMPLATES
from ebbtide.llm.tables import table
from ebbtide.session import materialise

FAMILIES = sorted(TEMPLATES)
#: Words of a training piece, share of confirmed word pairs, least probability and its steps, training rows of a task.
PIECES, CONFIRMED, LEAST, STEPS, PART = (5, 8, 13), 0.6, 0.5, 10000, 100_000
#: Share of a template's word pairs that a run inside a line must hold, and pairs that it must hold at least.
COVERED, FEWEST = 0.5, 3
#: What a pair adds to the score of a run: a run has the CONFIRMED share of pairs exactly if its score is not negative.
GAIN, LOSS = 2, 3


def words(text: str | Column) -> Column:
    """Words in lower case; what is not an ASCII letter, digit or dot inside a number separates them."""
    return F.array_remove(F.split(F.lower(text), r"[^a-z0-9]+"), "")


def runs(word: Column, n: int) -> Column:
    """All runs of n words, as strings."""
    return F.when(F.size(word) >= n, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(word) - n + 1, F.lit(1))),
        lambda i: F.array_join(F.slice(word, i, n), " "))).otherwise(F.array().cast("array<string>"))


def word_pairs(word: Column) -> Column:
    """All runs of two words, in order."""
    n = F.greatest(F.size(word) - 1, F.lit(0))
    return F.zip_with(F.slice(word, 1, n), F.slice(word, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def has_run(pairs: Column, own: list[str], fewest: int) -> Column:
    """False only if `matching_runs` finds nothing; the state is the score and, from the eleventh bit on, the pairs found."""
    # a score that could reach the eleventh bit has enough pairs already
    state = F.aggregate(pairs, F.lit(0), lambda s, p: F.when(s >= fewest << 10, s).when(p.isin(own), s + 1024 + GAIN).when(
        s % 1024 >= LOSS, s - LOSS).otherwise(0))
    return state >= fewest << 10


def matching_runs(pairs: Column, own: list[str], fewest: int) -> Column:
    """Runs (first pair, number of pairs, how many are in `own`) with at least the CONFIRMED share of pairs in `own`.

    A run begins with such a pair, is given up when its score gets negative, and ends where its score was highest."""
    kind = "array<struct<first:int,n:int,hits:int>>"
    zero = F.struct(*(F.lit(0).alias(c) for c in ("at", "first", "score", "hits", "best", "end", "most")),
                    F.array().cast(kind).alias("out"))

    def closed(s: Column) -> Column:
        run = F.struct(s["first"].alias("first"), (s["end"] - s["first"]).alias("n"), s["most"].alias("hits"))
        return F.when(s["most"] >= fewest, F.concat(s["out"], F.array(run))).otherwise(s["out"])

    def step(s: Column, p: Column) -> Column:
        at, known = s["at"] + 1, p.isin(own)
        hits, score = s["hits"] + 1, s["score"] + GAIN
        peak = score >= s["best"]
        found = (at, s["first"], score, hits, F.when(peak, score).otherwise(s["best"]),
                 F.when(peak, at).otherwise(s["end"]), F.when(peak, hits).otherwise(s["most"]), s["out"])
        missed = (at, s["first"], s["score"] - LOSS, s["hits"], s["best"], s["end"], s["most"], s["out"])
        given_up = (at, at, F.lit(0), F.lit(0), F.lit(0), at, F.lit(0), closed(s))
        names = ("at", "first", "score", "hits", "best", "end", "most", "out")
        named = [F.struct(*(c.alias(n) for c, n in zip(x, names))) for x in (found, missed, given_up)]
        return F.when(known, named[0]).when(s["score"] >= LOSS, named[1]).otherwise(named[2])

    return F.when(has_run(pairs, own, fewest), F.aggregate(pairs, zero, step, closed)).otherwise(F.array().cast(kind))


def grams(word: Column) -> Column:
    return F.array_distinct(F.concat(word, runs(word, 2), runs(word, 3)))


def literal_rows(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    listed = F.array(*(F.struct(F.lit(a).alias("family"), F.lit(b).alias("text")) for a, b in rows))
    return spark.range(1, numPartitions=1).select(F.inline(listed))


def templates(spark: SparkSession) -> DataFrame:
    rows = [(family, text) for family in FAMILIES for text in TEMPLATES[family]]
    return literal_rows(spark, rows).select("family", words("text").alias("words"))


def pieces(rows: DataFrame) -> DataFrame:
    """Every run of a few words of each paragraph, and the paragraph itself."""

    def cut(k: int) -> Column:
        first = F.sequence(F.lit(1), F.greatest(F.size("words") - k + 1, F.lit(1)))
        return F.transform(first, lambda i: F.slice("words", i, k))

    return rows.select("family", F.explode(F.array_distinct(F.concat(F.array("words"), *map(cut, PIECES)))).alias("words"))


class LicenceModel:
    """A fitted classifier, its features, the words they need, and the calibrated least probability."""

    def __init__(self, docs: DataFrame, text: str = "text"):
        spark = docs.sparkSession
        self.templates = materialise(templates(spark), "templates")
        plain = set(FUNCTION_WORDS.split())
        found = self.templates.select(F.explode(grams(F.col("words"))).alias("gram")).distinct().collect()
        self.features = sorted(r["gram"] for r in found if set(r["gram"].split(" ")) - plain)
        self.cues = sorted({w for g in self.features for w in g.split(" ")} - plain)
        pair = self.templates.select("family", F.explode(runs(F.col("words"), 2)).alias("pair")).distinct()
        first = pair.groupBy("family", F.substring_index("pair", " ", 1).alias("word")).count()
        followers = first.groupBy("word").agg(F.max("count").alias("most")).collect()
        #: How many pairs of one family's templates begin with a word, at most.
        self.followers = {w: 0 for g in found for w in g["gram"].split(" ")} | {r["word"]: r["most"] for r in followers}

        listed = self.templates.select("family", F.array_distinct(runs(F.col("words"), 2)).alias("pairs")).collect()
        #: Word pairs of each template by family, and how many of them a run must hold.
        self.pairs = {f: [(r["pairs"], max(FEWEST, min(COVERED * len(r["pairs"]), PIECES[-1] - 1)))
                          for r in listed if r["family"] == f] for f in FAMILIES}

        others = literal_rows(spark, [("", t) for t in OTHER]).select("family", words("text").alias("words"))
        made = pieces(self.templates.unionByName(others)).select("family", grams(F.col("words")).alias("grams")).distinct()
        made = made.select("family", "grams", (F.pmod(F.xxhash64("grams"), F.lit(5)) == 0).alias("held"),
                           F.lit(1).cast("long").alias("n"), F.lit(False).alias("line"))
        #: Lines of the documents, as `features` (grams), `held` and `n` (different lines with these features).
        self.lines = materialise(self.line_features(docs, text), "licence-lines-seen")
        known = F.array(*(F.lit(g) for g in self.features if g.count(" ") == 2))
        seen = self.lines.where(~F.arrays_overlap("grams", known)).select(
            F.lit("").alias("family"), "grams", "held", "n", F.lit(True).alias("line"))
        rows = made.unionByName(seen)
        position = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family"))
        rows = materialise(rows.withColumn("label", position.cast("double")), "licence-training")
        self.vectorizer = CountVectorizerModel.from_vocabulary(self.features, "grams", "features")
        self.vectorizer.setBinary(True)
        sizes = rows.where("not held").agg(
            F.count_if(~F.col("line")).alias("pieces"), F.sum(F.when(F.col("line"), F.col("n"))).alias("lines"),
            F.count(F.lit(1)).alias("rows")).first()
        share = min(1.0, sizes["pieces"] / max(1, sizes["lines"] or 0))
        rows = rows.withColumn("weight", F.when(F.col("line"), F.col("n") * share).otherwise(1.0))
        learned = rows.where("not held").coalesce(max(4, sizes["rows"] // PART))
        fit = LogisticRegression(
            family="multinomial", regParam=0.001, elasticNetParam=0.5, maxIter=60, weightCol="weight")
        self.model = fit.fit(self.vectorizer.transform(learned))
        step = (F.ceil(F.col("probability_of") * STEPS) / STEPS).alias("step")
        reached = self.scored(rows.where("held and label = 0")).groupBy(step).agg(F.sum("n").alias("n"))
        reached = reached.orderBy("step").collect()
        most, total = 0.0, sum(r["n"] for r in reached)
        for r, up_to in zip(reached, itertools.accumulate(r["n"] for r in reached)):
            most = r["step"]
            if up_to >= 0.99 * total:
                break
        self.least = max(LEAST, most)

    def line_features(self, docs: DataFrame, text: str) -> DataFrame:
        """The `grams` that are features, of every line of the documents that has words: how many different lines (`n`)
        have them, apart for those held back from the fit. Lines without a cue have none, so no n-grams are made."""
        cues, features = F.array(*map(F.lit, self.cues)), F.array(*map(F.lit, self.features))
        lines = docs.select(F.explode(F.transform(F.split(text, "\n"), words)).alias("words")).where(F.size("words") > 0)
        two = word_pairs(F.col("words"))
        n = F.greatest(F.size("words") - 2, F.lit(0))
        three = F.zip_with(F.slice(two, 1, n), F.slice("words", 3, n), lambda a, b: F.concat(a, F.lit(" "), b))
        own = F.array_sort(F.array_intersect(F.concat("words", two, three), features))
        lines = lines.select(F.xxhash64("words").alias("line"), F.when(F.arrays_overlap("words", cues), own).otherwise(
            F.array().cast("array<string>")).alias("grams")).distinct()
        return lines.groupBy("grams", (F.pmod("line", F.lit(5)) == 0).alias("held")).agg(F.count(F.lit(1)).alias("n"))

    def could_be_confirmed(self, word: Column) -> Column:
        """False only if fewer than the CONFIRMED share of the distinct word pairs can be those of one family.

        Each word outside the templates, but for the last of the paragraph, begins a pair that is not theirs; each one
        inside begins as many of theirs as `followers` says, and not more than there are places left."""
        known = F.array(*map(F.lit, sorted(self.followers)))
        most = F.create_map(*(F.lit(x) for w in sorted(self.followers) for x in (w, self.followers[w])))
        other = F.size(F.array_except(word, known)) - 1
        theirs = F.aggregate(F.array_intersect(word, known), F.lit(0), lambda n, w: n + F.element_at(most, w))
        places = F.size(word) - 1 - other
        return (other * CONFIRMED <= places * (1 - CONFIRMED) + 1e-9) & (
            other * CONFIRMED <= theirs * (1 - CONFIRMED) + 1e-9)

    def own_pairs(self, family: str) -> list[str]:
        return sorted({p for pairs, _ in self.pairs[family] for p in pairs})

    def any_run(self, word: Column) -> Column:
        """False only if `runs_in` finds no run."""
        every = sorted({p for f in FAMILIES for p in self.own_pairs(f)})
        return has_run(word_pairs(word), every, FEWEST)

    def runs_in(self, word: Column) -> Column:
        """Runs of a line that hold enough of a template: family, first pair, number of pairs, and how many are the
        family's."""
        pairs = word_pairs(word)

        def of(family: str) -> Column:  # the functions below take one parameter: a second one would be the index
            fewest = math.ceil(min(n for _, n in self.pairs[family]))

            def whole(r: Column) -> Column:
                own = F.slice(pairs, r["first"] + 1, r["n"])
                held = [F.size(F.array_intersect(own, F.array(*map(F.lit, t)))) >= n for t, n in self.pairs[family]]
                return functools.reduce(Column.__or__, held)

            return F.transform(F.filter(matching_runs(pairs, self.own_pairs(family), fewest), whole), lambda r: F.struct(
                F.lit(family).alias("family"), r["first"].alias("first"), r["n"].alias("n"), r["hits"].alias("hits")))

        return F.concat(*map(of, FAMILIES))

    def scored(self, rows: DataFrame) -> DataFrame:
        """Adds `predicted` (the likeliest family) and `probability_of` it; `unknown` is not a family."""
        done = self.model.transform(self.vectorizer.transform(rows)).withColumn(
            "p", F.slice(vector_to_array("probability"), 2, len(FAMILIES)))
        best = F.array_max("p")
        return done.withColumn("probability_of", best).withColumn(
            "predicted", F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position("p", best).cast("int"))).drop(
            "features", "rawPrediction", "probability", "prediction", "p")


def licence_paragraphs(docs: DataFrame, model: LicenceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each line and each family confirmed in it: `key`, `place` (line number from 0), `paragraph` (the line),
    `family`, `probability`, `confirmed_share` (both of the likeliest run). NULL and empty texts have none."""
    cues = F.array(*map(F.lit, model.cues))
    listed = F.transform(F.split(text, "\n"), lambda p: F.struct(p.alias("paragraph"), words(p).alias("words")))
    lines = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
                        F.posexplode(listed).alias("place", "line"))
    lines = lines.select("row", "key", "place", "line.paragraph", "line.words").where(
        F.arrays_overlap("words", cues) & (model.could_be_confirmed(F.col("words")) | model.any_run(F.col("words"))))
    lines = materialise(lines.withColumn("found", model.runs_in(F.col("words"))), "licence-lines")
    best = F.filter("found", lambda r: ~F.exists("found", lambda q: (q["hits"] > r["hits"]) & (
        q["first"] < r["first"] + r["n"]) & (r["first"] < q["first"] + q["n"])))
    inside = F.transform(best, lambda r: F.struct(
        r["family"].alias("wanted"), F.slice("words", r["first"] + 1, r["n"] + 1).alias("words"),
        (r["hits"] / r["n"]).alias("run_share")))
    line = F.struct(F.lit(None).cast("string").alias("wanted"), F.col("words"), F.lit(None).cast("double").alias("run_share"))
    whole = F.when(model.could_be_confirmed(F.col("words")), F.array(line)).otherwise(F.array().cast(
        "array<struct<wanted:string,words:array<string>,run_share:double>>"))
    tried = lines.select("row", "key", "place", "paragraph", F.inline(F.concat(whole, inside)))
    rows = model.scored(tried.withColumn("grams", grams(F.col("words")))).where(
        (F.col("probability_of") >= model.least) & F.coalesce(F.col("wanted") == F.col("predicted"), F.lit(True)))
    pairs = model.templates.select("family", F.explode(F.array_distinct(runs(F.col("words"), 2))).alias("pair"))
    pairs = pairs.groupBy("family").agg(F.collect_set("pair").alias("pairs"))
    own = F.array_distinct(runs(F.col("words"), 2))
    share = F.coalesce("run_share", F.size(F.array_intersect(own, "pairs")) / F.greatest(F.size(own), F.lit(1)))
    rows = rows.join(F.broadcast(pairs), F.col("predicted") == F.col("family")).withColumn("share", share).where(
        F.col("share") >= CONFIRMED)
    likeliest = F.max(F.struct("probability_of", "share")).alias("best")
    return rows.groupBy("row", "key", "place", "paragraph", "family").agg(likeliest).select(
        F.col("key").alias(key), "place", "paragraph", "family", F.col("best.probability_of").alias("probability"),
        F.col("best.share").alias("confirmed_share"))


def op7_licenses(spark, folder: str) -> DataFrame:
    """One row per document: families found (sorted), number of licence paragraphs (a line counts once for each family),
    and the likeliest family."""
    docs = table(spark, folder, "documents")
    found = licence_paragraphs(docs, LicenceModel(docs))
    as_text = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("found_key")
    listed = found.groupBy(as_text).agg(
        F.array_sort(F.collect_set("family")).alias("families"), F.count(F.lit(1)).alias("n_paragraphs"),
        F.max_by("family", F.struct("probability", "family")).alias("license"))
    rows = docs.select("doc_id", as_text).join(materialise(listed, "licences"), "found_key", "left")
    return rows.select(
        "doc_id", F.coalesce("license", F.lit("none")).alias("license"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"),
        F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"))
