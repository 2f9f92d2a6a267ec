"""Merkle manifest of a dataset, with leaf places from bitmaps and ranks instead of sorted rows.

Each row is a leaf. The leaves of a group (a source) ascend by key; while several nodes remain, every three consecutive
ones become one, and the last nodes of the groups, in the order of the groups, become the root in the same way.

**Places.** The keys of a group are a bitmap: 64-bit words, of which empty ones are left out, in containers of 512 words.
A container lists its words, tells with eight more words which they are (their rank is a popcount), and keeps the number
of rows before each of them; keys that occur more than once add to these numbers. Rows before a container come from a
directory with at most 4096 children per node, level by level, so no group and no task ever holds all containers of a
source. The place of a key is then: rows before the container, plus rows before the word, plus a popcount, plus repeats.

**Levels.** A key and its rows are a run of places. Runs are keyed by (group, place div 729) and become slots of an array;
six levels are hashed inside the array, and the next round does the same with what is left of each array. Going back
down, each node gets the siblings beside it at every level, which give the proof and the root that a changed leaf leads to.

Only DataFrame functions. A NULL key precedes all others. Rows with one key in a group are ordered by their leaf, in
buckets of its first three digits, and rows that agree in all fields are a run of their own; they differ in their place
alone. A NULL group precedes all others. An empty table has no rows, one row has its leaf as subroot and root and the
hash of nothing as proof. NULL fields, empty and long texts are hashed like any others; other columns, whatever their
names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.tables import table
from ebbtide.session import materialise

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node; levels hashed in one array; places of such an array; children of a directory node (as bits).
FANOUT, LEVELS, FAN_BITS = 3, 6, 12
SLOTS = FANOUT**LEVELS
#: Bits of a word's place in the bitmap, and of a container's.
WORD_BITS, CONTAINER_BITS = 6, 15


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` if NULL, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, key: str, group: str, text: str, fields: tuple[str, ...], tampered: Column) -> DataFrame:
    """`grp` (the group as a field), `key`, `leaf`, and `changed`, the leaf after tampering if that changes the text."""
    parts = {c: field(F.col(f"`{c}`")) for c in fields}
    other = parts | {text: field(F.translate(F.col(f"`{text}`"), "\n", ""))}
    touched = tampered & F.coalesce(F.instr(F.col(f"`{text}`"), "\n") > 0, F.lit(False))
    return docs.select(
        parts[group].alias("grp"), F.col(f"`{group}`").cast("string").alias("grp_name"), F.col(f"`{key}`").alias("key"),
        digest(*parts.values()).alias("leaf"), F.when(touched, digest(*other.values())).alias("changed"))


def rows_before(counted: DataFrame, keys: list[str], place: str, bits: int = FAN_BITS) -> DataFrame:
    """Adds `base`, the sum of `n` over smaller `place` among rows with the same keys; places are distinct there.

    A directory: sums of 2**bits neighbours, sums of these, and so on. No window holds more than 2**bits rows (two times
    that at the top).
    """
    least, most = counted.agg(F.min(place), F.max(place)).first()
    levels, shift = [counted], 0
    while least is not None and (most >> shift) - (least >> shift) >= 1 << bits:
        shift += bits
        up = F.shiftright(place, bits).alias(place)
        levels.append(materialise(levels[-1].groupBy(*keys, up).agg(F.sum("n").alias("n")), "directory"))
    base = None
    for level in reversed(levels):
        parent = F.shiftright(place, bits)
        inner = Window.partitionBy(*keys, *([parent] if base is not None else [])).orderBy(place)
        inner = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        here = level.withColumn("base", F.sum("n").over(inner) - F.col("n"))
        if base is not None:
            above = base.select(*keys, F.col(place).alias("up"), F.col("base").alias("above"))
            here = here.withColumn("up", parent).join(above, [*keys, "up"]).withColumn(
                "base", F.col("base") + F.col("above")).drop("up", "above")
        base = materialise(here, "bases")
    return base


def set_bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def low_bits(number: Column, bits: int) -> Column:
    return number.bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")


def containers(ids: DataFrame) -> DataFrame:
    """The bitmaps of `ids` (grp, key, n): `grp`, `container`, `present`, `bits`, `before`, `repeats`, `base`."""
    place = low_bits(F.col("key"), WORD_BITS)
    words = ids.groupBy("grp", F.shiftright("key", WORD_BITS).alias("word")).agg(
        F.bit_or(set_bit(place)).alias("bits"), F.sum("n").alias("n"), F.collect_list(F.when(
            F.col("n") > 1, F.struct(place.alias("bit"), (F.col("n") - 1).alias("more")))).alias("repeats"))
    spot = low_bits(F.col("word"), CONTAINER_BITS - WORD_BITS)
    held = words.groupBy("grp", F.shiftright("word", CONTAINER_BITS - WORD_BITS).alias("container")).agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct(spot.alias("spot"), "bits", "n", "repeats"))).alias("w"))
    zero = F.lit(0).cast("long")
    part = lambda k: F.aggregate(
        F.filter("w", lambda w: F.floor(w["spot"] / 64) == k), zero, lambda s, w: s.bitwiseOR(set_bit(w["spot"] % 64)))
    sums = F.aggregate("w", F.array(zero), lambda s, w: F.concat(s, F.array(F.element_at(s, -1) + w["n"])))
    held = held.select("grp", "container", "n", F.array(*(part(k) for k in range(8))).alias("present"),
                       F.col("w.bits").alias("bits"), sums.alias("before"), F.col("w.repeats").alias("repeats"))
    return rows_before(materialise(held, "containers"), ["grp"], "container")


def below(bits: Column, place: Column) -> Column:
    """How many of the bits before `place` are set."""
    return F.bit_count(bits.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), place)))).cast("long")


def rank(key: Column) -> Column:
    """Rows with a smaller key, from the container of the key."""
    at = lambda a, i: F.element_at(F.col(a), i + 1)
    spot = low_bits(F.shiftright(key, WORD_BITS), CONTAINER_BITS - WORD_BITS)
    eighth = F.floor(spot / 64).cast("int")
    earlier = F.aggregate(F.slice("present", F.lit(1), eighth), F.lit(0).cast("long"), lambda s, p: s + F.bit_count(p))
    word = (earlier + below(at("present", eighth), spot % 64)).cast("int")
    bit = low_bits(key, WORD_BITS)
    more = F.aggregate(F.filter(at("repeats", word), lambda r: r["bit"] < bit), F.lit(0).cast("long"),
                       lambda s, r: s + r["more"])
    return F.col("base") + at("before", word) + below(at("bits", word), bit) + more


def runs_of(rows: DataFrame) -> DataFrame:
    """Runs of equal rows: `grp`, `place` (of the first one, from 0), `n`, `key`, `leaf`, `changed`."""
    ids = rows.groupBy("grp", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("leaf").alias("leaf"), F.max("leaf").alias("last"),
        F.max("changed").alias("changed"))
    ids = materialise(ids, "keys")
    nulls = ids.where("key is null").select("grp", F.col("n").alias("nulls"))
    ranked = ids.where("key is not null").withColumn("container", F.shiftright("key", CONTAINER_BITS)).join(
        containers(ids.where("key is not null").select("grp", "key", "n")).drop("n"), ["grp", "container"])
    ranked = ranked.join(nulls, "grp", "left").withColumn("place", rank(F.col("key")) + F.coalesce("nulls", F.lit(0)))
    columns = ["grp", "place", "n", "key", "leaf", "changed"]
    first = ids.where("key is null").withColumn("place", F.lit(0).cast("long"))
    placed = materialise(ranked.select(*columns, "last").unionByName(first.select(*columns, "last")), "places")
    alike, unlike = placed.where("leaf = last").select(*columns), placed.where("leaf < last")
    if unlike.isEmpty():
        return alike
    # different rows with one key: ordered by their leaf, in 4096 buckets of it
    mixed = rows.withColumn("no_key", F.col("key").isNull()).withColumn("key", F.coalesce("key", F.lit(0))).join(
        unlike.select("grp", F.col("key").isNull().alias("no_key"), F.coalesce("key", F.lit(0)).alias("key"),
                      F.col("place").alias("start")), ["grp", "no_key", "key"])
    same = ["grp", "no_key", "key", "start"]
    mixed = mixed.groupBy(*same, "leaf").agg(F.count(F.lit(1)).alias("n"), F.max("changed").alias("changed"))
    mixed = materialise(mixed.withColumn("part", F.conv(F.substring("leaf", 1, 3), 16, 10).cast("long")), "unlike")
    parts = rows_before(mixed.groupBy(*same, "part").agg(F.sum("n").alias("n")), same, "part")
    order = Window.partitionBy(*same, "part").orderBy("leaf").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mixed = mixed.join(parts.drop("n"), [*same, "part"]).withColumn(
        "place", F.col("start") + F.col("base") + F.sum("n").over(order) - F.col("n"))
    return alike.unionByName(mixed.withColumn("key", F.when(~F.col("no_key"), F.col("key"))).select(*columns))


def height(n: Column) -> Column:
    """Levels above n leaves."""
    return F.size(F.filter(F.array(*(F.lit(FANOUT**k) for k in range(40))), lambda x: x < n))


def parents(nodes: Column) -> Column:
    last = F.floor((F.size(nodes) - 1) / FANOUT).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: digest(F.array_join(F.slice(nodes, i * FANOUT + 1, FANOUT), "")))


def with_levels(arrays: DataFrame) -> DataFrame:
    """Adds `l1` ... `l6` over the digests `l0`, as far as `levels` says; the others repeat the last one."""
    for k in range(LEVELS):
        arrays = arrays.withColumn(
            f"l{k + 1}", F.when(F.col("levels") > k, parents(F.col(f"l{k}"))).otherwise(F.col(f"l{k}")))
    return arrays


def path(slot: Column) -> Column:
    """What stands left and right of the node at a slot and of those above it, one entry for each level of the array."""

    def beside(k: int) -> Column:
        at, nodes = F.floor(slot / FANOUT**k).cast("int"), F.col(f"l{k}")
        inner = at % FANOUT
        return F.struct(F.array_join(F.slice(nodes, at - inner + 1, inner), "").alias("before"),
                        F.array_join(F.slice(nodes, at + 2, FANOUT - 1 - inner), "").alias("after"))

    return F.slice(F.array(*(beside(k) for k in range(LEVELS))), F.lit(1), F.col("levels"))


class Tree:
    """Trees over the nodes (grp, place, n, digest) of all groups; a row stands for n equal nodes from `place` on.

    `sizes` has `grp` and `leaves`, the number of nodes. Further columns of the nodes stay with them.
    """

    def __init__(self, nodes: DataFrame, sizes: DataFrame):
        kept = [c for c in nodes.columns if c not in ("grp", "place", "n", "digest")]
        self.kept, self.arrays = kept, []
        sizes = materialise(sizes.select("grp", height(F.col("leaves")).alias("height")), "heights")
        highest = sizes.agg(F.max("height")).first()[0]
        for step in range(max(1, -(-(highest or 0) // LEVELS))):
            end = F.col("place") + F.col("n") - 1
            block = F.explode(F.sequence(F.floor(F.col("place") / SLOTS), F.floor(end / SLOTS)))
            cut = nodes.withColumn("end", end).withColumn("block", block)
            start = F.greatest(F.col("place"), F.col("block") * SLOTS)
            held = F.least(F.col("end"), F.col("block") * SLOTS + SLOTS - 1) - start + 1
            slots = cut.groupBy("grp", "block").agg(F.array_sort(F.collect_list(F.struct(
                (start - F.col("block") * SLOTS).cast("int").alias("slot"), held.cast("int").alias("n"), "digest",
                *(kept if not step else [])))).alias("runs"))
            slots = slots.join(sizes, "grp").withColumn(
                "levels", F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.col("height") - step * LEVELS))).drop("height")
            slots = slots.withColumn(
                "l0", F.flatten(F.transform("runs", lambda r: F.array_repeat(r["digest"], r["n"]))))
            slots = materialise(with_levels(slots), "arrays")
            self.arrays.append(slots)
            nodes = slots.select("grp", F.col("block").alias("place"), F.lit(1).cast("long").alias("n"),
                                 F.element_at(f"l{LEVELS}", 1).alias("digest"))
        #: `grp` and `digest` of the last node of each group.
        self.roots = materialise(nodes.select("grp", "digest"), "roots")

    def paths(self, above: DataFrame) -> DataFrame:
        """The arrays of leaves with `over`: the paths of their last nodes, then `above` (grp, over) of the group."""
        for slots in reversed(self.arrays[1:]):
            inner = slots.join(above, "grp" if above.columns == ["grp", "over"] else ["grp", "block"])
            steps = F.transform("l0", lambda d, i: F.struct(i.alias("slot"), F.concat(path(i), F.col("over")).alias("over")))
            listed = inner.select("grp", "block", F.inline(steps))
            above = materialise(
                listed.select("grp", (F.col("block") * SLOTS + F.col("slot")).alias("block"), "over"), "paths")
        return self.arrays[0].join(above, "grp" if above.columns == ["grp", "over"] else ["grp", "block"])


def ordered_groups(rows: DataFrame) -> DataFrame:
    """`grp`, `place` (in the order of the groups' names, NULL first) and `leaves`.

    The names are range-partitioned, sorted inside the partitions, and partitions are added up.
    """
    counts = rows.groupBy("grp", "grp_name").agg(F.count(F.lit(1)).alias("leaves"))
    inner = counts.repartitionByRange("grp_name").sortWithinPartitions("grp_name").select(
        "grp", "leaves", F.monotonically_increasing_id().alias("id"))
    inner = materialise(inner, "groups").withColumn("part", F.shiftright("id", 33))
    parts = rows_before(inner.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0)), ["all"], "part")
    return materialise(inner.join(parts.select("part", "base"), "part").select(
        "grp", (F.col("base") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"), "leaves"), "group-places")


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", text: str = "text",
             fields: tuple[str, ...] = FIELDS, tampered: Column | None = None) -> DataFrame:
    """`key`, `leaf`, `subroot`, `root`, `proof_sha256`, `folded_root`, `verified` for each row of `docs`.

    `proof_sha256` is the hash of the siblings of the leaf and of the nodes above it; `folded_root` is what they and the
    leaf lead to, or, where `tampered` holds, the leaf of the row without the line ends of its text.
    """
    if tampered is None:
        tampered = F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    rows = materialise(leaves(docs, key, group, text, fields, tampered), "leaves")
    groups = ordered_groups(rows)
    tree = Tree(runs_of(rows).withColumnRenamed("leaf", "digest"), groups.select("grp", "leaves"))
    named = tree.roots.join(groups.select("grp", "place"), "grp").select(
        F.lit("all").alias("grp"), "place", F.lit(1).cast("long").alias("n"), "digest", F.col("grp").alias("name"))
    named = materialise(named, "subroots")
    top = Tree(named, named.groupBy("grp").agg(F.count(F.lit(1)).alias("leaves")))
    root = top.roots.first()
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    upper = top.paths(top.roots.select("grp", nothing.alias("over")))
    upper = upper.select(F.posexplode("l0").alias("slot", "subroot"), "runs", "over", "levels",
                         *(f"l{k}" for k in range(LEVELS + 1)))
    upper = upper.select(F.element_at("runs", F.col("slot") + 1)["name"].alias("grp"), "subroot",
                         F.concat(path(F.col("slot")), F.col("over")).alias("over"))
    upper = materialise(upper, "group-paths")
    below_ = tree.paths(upper.select("grp", "over")).join(upper.select("grp", "subroot"), "grp")
    return proofs(below_, F.lit(root["digest"] if root else None).cast("string"), key)


def proofs(arrays: DataFrame, root: Column, key: str) -> DataFrame:
    """One row for each leaf of the arrays."""
    listed = F.flatten(F.transform("runs", lambda r: F.transform(
        F.sequence(r["slot"], r["slot"] + r["n"] - 1), lambda s: F.struct(
            r["key"].alias("key"), r["digest"].alias("leaf"), r["changed"].alias("changed"),
            F.concat(path(s), F.col("over")).alias("steps")))))
    rows = arrays.withColumn("listed", listed).select("subroot", F.explode("listed").alias("x")).select("subroot", "x.*")
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), "")
    folded = F.aggregate("steps", F.coalesce("changed", "leaf"), lambda d, s: digest(s["before"], d, s["after"]))
    rows = rows.select(F.col("key").alias(key), "leaf", "subroot", root.alias("root"), digest(siblings).alias("proof_sha256"),
                       folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark, folder: str) -> DataFrame:
    return manifest(table(spark, folder, "documents"))
