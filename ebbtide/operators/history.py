"""One feature row per client, from one pass over the sales.

The sales are first added up per client, day and product. That shuffle moves a dozen numbers per group, spreads a
busy client over its days, and leaves every client with no more rows than days times products. The second shuffle,
by client, serves the gaps, the history, the look-back windows, the activity filter and the label together.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import APPROVED, IN_PERSON, ONLINE
from ..functions import channel, sum_or_zero, weekday_number
from ..params import Study

HISTORY = [
    "days_between_last_two", "gap_deviation", "mean_gap", "mean_ticket", "ticket_deviation", "total_amount",
    "last_sale_month", "weekday_sales", "weekend_sales", "products", "sells_online", "sells_in_person",
    "sells_mixed", "sales", "approved", "approval_rate", "new_client",
]
FLAG_COLUMNS = ["sells_online", "sells_in_person", "sells_mixed", "new_client"]
RATIOS = ["activity_change", "frequency_change", "ticket_change"]


def window_columns(windows: tuple[int, ...]) -> list[str]:
    return [f"{kind}_{d}d" for d in windows for kind in ("sales", "amount", "ticket")]


def client_days(sales: DataFrame) -> DataFrame:
    """Counts, sums and squared deviations per client, day and product."""
    amount = F.col("amount")
    return sales.groupBy("client_id", "sale_date", "product").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("status").alias("n_status"),
        F.count_if(F.col("status") == APPROVED).alias("n_approved"),
        F.count(amount).alias("n_amount"),
        F.sum(amount).alias("amount_sum"),
        (F.var_pop(amount) * F.count(amount)).alias("amount_m2"),
    )


def _days_with_gaps(sales: DataFrame, cut: dt.date, since: dt.date | None, horizon: int) -> DataFrame:
    """Client days up to `cut` with the gap to the day before; days after `cut` keep only the `returned` mark.

    `new_product` marks a product's first day: counting marks costs one more sort of rows already in place, where a
    distinct count would carry every other measure through two more aggregates.
    `pivot`, the client's first mean amount, is what squared deviations are taken from: near the data, so no digits
    are lost, and known without a second pass over the client.
    """
    last = cut + dt.timedelta(days=horizon)
    rows = sales.filter(F.col("sale_date") <= F.lit(last))
    if since is not None:
        rows = rows.filter(F.col("sale_date") >= F.lit(since))
    days = client_days(rows)
    in_order = Window.partitionBy("client_id").orderBy("sale_date", "product")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mean = F.try_divide(F.col("amount_sum"), F.col("n_amount"))
    # Marks come after the window, so the shuffle carries each column once.
    ordered = days.withColumns({
        "gap": F.datediff("sale_date", F.lag("sale_date").over(in_order)),
        "next_day": F.lead("sale_date").over(in_order),
        "pivot": F.first(mean, ignorenulls=True).over(so_far),
    })
    past = F.col("sale_date") <= F.lit(cut)

    def keep(column: str) -> Column:
        return F.when(past, F.col(column)) if horizon else F.col(column)

    measures = ["product", "n", "n_status", "n_approved", "n_amount", "amount_sum", "amount_m2", "gap", "pivot"]
    by_product = Window.partitionBy("client_id", "product").orderBy("day")  # sorts within the client's partition
    followed = F.coalesce(F.col("next_day") <= F.lit(cut), F.lit(False))
    marked = ordered.select(
        "client_id",
        *[keep(c).alias(c) for c in measures],
        keep("sale_date").alias("day"),
        (past & ~followed).alias("is_last"),
        (~past).alias("returned"),
    )
    first_day = F.row_number().over(by_product) == 1
    return marked.withColumn("new_product", first_day & F.col("product").isNotNull())


def _gap_measures() -> dict[str, Column]:
    """Same-day gaps are 0: they add to the number of gaps, not to the sums."""
    n = F.sum("n")
    gaps = n - 1
    total = F.datediff(F.max("day"), F.min("day")).cast("long")
    squares = F.coalesce(F.sum(F.col("gap").cast("long") * F.col("gap")), F.lit(0))
    last_gap = F.when(F.col("n") >= 2, 0).otherwise(F.col("gap"))
    return {
        "days_between_last_two": F.max(F.when(F.col("is_last"), last_gap)).cast("double"),
        "gap_deviation": F.when(gaps >= 2, F.sqrt((gaps * squares - total * total) / (gaps * (gaps - 1)))),
        "mean_gap": F.when(n > 1, total / gaps),
    }


def _history_measures(cut: dt.date, new_client_days: int) -> dict[str, Column]:
    n, paid = F.sum("n"), F.sum("n_amount")
    weekend = weekday_number(F.col("day")).isin(6, 7)
    kind = channel(F.col("product"))
    known = F.col("product").isNotNull()
    online, in_person = F.bool_or(known & (kind == ONLINE)), F.bool_or(known & (kind == IN_PERSON))
    approved = F.when(F.sum("n_status") == n, F.sum("n_approved"))
    mean = F.try_divide(F.sum("amount_sum"), paid)
    offset = F.try_divide(F.col("amount_sum"), F.col("n_amount")) - F.col("pivot")
    around_pivot = F.sum(F.col("amount_m2") + F.col("n_amount") * offset * offset)
    pivot = F.max("pivot")
    spread = F.greatest(around_pivot - paid * (mean - pivot) * (mean - pivot), F.lit(0.0))
    return _gap_measures() | {
        "mean_ticket": mean,
        "ticket_deviation": F.when(paid > 1, F.sqrt(spread / (paid - 1))),
        "total_amount": sum_or_zero(F.col("amount_sum")),
        "last_sale_month": F.month(F.max("day")),
        "weekday_sales": F.coalesce(F.sum(F.when(~weekend, F.col("n"))), F.lit(0)),
        "weekend_sales": F.coalesce(F.sum(F.when(weekend, F.col("n"))), F.lit(0)),
        "products": F.count_if("new_product"),
        "sells_online": online,
        "sells_in_person": in_person,
        "sells_mixed": online & in_person,
        "sales": n,
        "approved": approved,
        "approval_rate": F.try_divide(approved.cast("double"), n),
        "new_client": F.min("day") >= F.lit(cut - dt.timedelta(days=new_client_days)),
    }


def _window_measures(cut: dt.date, windows: tuple[int, ...]) -> dict[str, Column]:
    """Count, sum and mean per look-back window; sum and mean are NULL without a sale in it."""
    measures = {}
    for d in windows:
        recent = F.col("day") > F.lit(cut - dt.timedelta(days=d))

        def total(column: str) -> Column:
            return F.sum(F.when(recent, F.col(column)))

        count = F.coalesce(total("n"), F.lit(0))
        measures[f"sales_{d}d"] = count
        measures[f"amount_{d}d"] = F.when(count > 0, F.coalesce(total("amount_sum"), F.lit(0.0)))
        measures[f"ticket_{d}d"] = F.try_divide(total("amount_sum"), total("n_amount"))
    return measures


def client_gaps(sales: DataFrame, cut: dt.date, since: dt.date | None = None) -> DataFrame:
    """Gap measures of every client with a sale up to `cut`."""
    days = _days_with_gaps(sales, cut, since, 0)
    measures = {"sales": F.sum("n")} | _gap_measures()
    return days.groupBy("client_id").agg(*[column.alias(name) for name, column in measures.items()])


def client_features(
    sales: DataFrame, study: Study, since: dt.date | None = None, cut: dt.date | None = None, labelled: bool = True
) -> DataFrame:
    """History and look-back windows of the clients active at `cut`; `churned` is 1 without a sale in the horizon.

    Active means a last sale within `cohort_days`, so the cohort is a filter on the aggregate and needs no join.
    Callers select what they use: unused measures are pruned from the plan.
    """
    cut = cut or study.cut
    days = _days_with_gaps(sales, cut, since, study.horizon if labelled else 0)
    measures = _history_measures(cut, study.new_client_days) | _window_measures(cut, study.windows)
    columns = [column.alias(name) for name, column in measures.items()]
    if labelled:
        columns.append((1 - F.max(F.col("returned").cast("int"))).alias("churned"))
    per_client = days.groupBy("client_id").agg(F.max("day").alias("last_sale"), *columns)
    return per_client.filter(
        F.col("last_sale") > F.lit(cut - dt.timedelta(days=study.cohort_days))
    ).drop("last_sale")


def churn_label(sales: DataFrame, study: Study) -> DataFrame:
    """Cohort and label alone: one shuffle of two numbers per client."""
    day, cut = F.col("sale_date"), F.lit(study.cut)
    recent = sales.filter(
        (day > F.lit(study.cut - dt.timedelta(days=study.cohort_days))) & (day <= F.lit(study.last_look_ahead()))
    )
    return (
        recent.groupBy("client_id")
        .agg(F.bool_or(day <= cut).alias("active"), F.bool_or(day > cut).alias("returned"))
        .filter("active")
        .select("client_id", F.when(F.col("returned"), 0).otherwise(1).alias("churned"))
    )


def with_ratios(features: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """Change of activity, frequency and ticket between the shortest window and the longer past."""
    short, longer = windows[0], windows[1]
    filled = features.fillna(0.0, [f"ticket_{d}d" for d in windows])
    recent = F.col(f"sales_{short}d")
    return filled.withColumns({
        "activity_change": recent / F.greatest(F.col(f"sales_{longer}d") * (short / longer), F.lit(1.0)),
        "frequency_change": short / F.greatest(recent, F.lit(1)) - F.col("mean_gap"),
        "ticket_change": F.try_divide(F.col(f"ticket_{short}d") - F.col("mean_ticket"), F.col("mean_ticket")),
    })
