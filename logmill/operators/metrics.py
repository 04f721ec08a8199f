"""Parse metrics, all computed from one count per (truth, prediction) pair.

``pairs`` has the columns ``gt`` and ``pred``; ``by`` names columns (such as the dataset) to score apart.
Every metric is a sum of small per-template tables, combined by union and one final sum, so a template
that holds a third of all lines is one pre-aggregated row long before any group is looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import loose_equal
from ..session import materialize


def pair_counts(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return pairs.groupBy(*by, "gt", "pred").agg(F.count(F.lit(1)).alias("n"))


def _stored_counts(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """The pair counts, written out once: both sides group them again, the logs are scanned only once."""
    return materialize(pair_counts(pairs, by))


def _rate(num: str, den: str) -> Column:
    return F.try_divide(F.col(num).cast("double"), F.col(den).cast("double"))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * (p * r), p + r), F.lit(0.0))


def _combine(parts: Sequence[DataFrame], by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Union partial one-row-per-``by`` tables and add them up."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return union.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))


def template_set(templates: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A set of templates as column ``gt``, and which of the ``by`` columns it has: a set may differ by dataset."""
    own = [c for c in by if c in templates.columns]
    column = next(c for c in templates.columns if c not in own)
    return templates.select(*own, F.col(column).alias("gt")).distinct(), own


def _flag(counts: DataFrame, templates: DataFrame | None, name: str, by: Sequence[str]) -> DataFrame:
    """Mark the rows whose truth is in the set ``templates``; all rows if there is no set."""
    if templates is None:
        return counts.withColumn(name, F.lit(True))
    known, own = template_set(templates, by)
    return counts.join(known.withColumn(name, F.lit(True)), [*own, "gt"], "left").withColumn(
        name, F.coalesce(name, F.lit(False))
    )


def _truth_side(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    return counts.groupBy(*by, "gt").agg(
        F.count(F.lit(1)).alias("n_pred"),
        F.min("pred").alias("pred"),
        F.sum("n").alias("n"),
        F.max("inside").alias("inside"),
    )


def _prediction_side(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    return counts.groupBy(*by, "pred").agg(
        F.count(F.lit(1)).alias("n_gt"),
        F.min("gt").alias("gt"),
        F.sum("n").alias("n"),
        F.max("inside").alias("inside"),
    )


def _side_parts(
    counts: DataFrame, by: Sequence[str], templates: DataFrame | None, loose: bool = False
) -> list[DataFrame]:
    """Sizes of both sides and the number of correct templates."""
    truth, prediction = _truth_side(counts, by), _prediction_side(counts, by)
    correct = loose_equal(F.col("pred"), F.col("gt")) if loose else F.col("gt") == F.col("pred")
    parts = [
        truth.where("inside").groupBy(*by).agg(
            F.sum("n").alias("lines"), F.count(F.lit(1)).alias("gt_present")
        ),
        prediction.groupBy(*by).agg(
            F.count_if("inside").alias("identified"),
            F.count_if(F.col("inside") & (F.col("n_gt") == 1) & correct).alias("ok_templates"),
        ),
    ]
    if templates is not None:
        known, own = template_set(templates, by)
        size = known.groupBy(*own).agg(F.count(F.lit(1)).alias("ground"))
        if by:
            each = truth.select(*by).distinct()
            size = each.join(size, own) if own else each.withColumn("ground", size.scalar())
        parts.append(size)
    return parts


def _group_part(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups that keep together on both sides: one prediction for the truth, one truth for the prediction."""
    truth = _truth_side(counts, by).where((F.col("n_pred") == 1) & F.col("inside"))
    prediction = _prediction_side(counts, by).where(F.col("n_gt") == 1).drop("inside", "n")
    return (
        truth.join(prediction, [*by, "gt", "pred"])
        .groupBy(*by)
        .agg(F.sum("n").alias("ok_lines"), F.count(F.lit(1)).alias("ok_groups"))
    )


def _line_part(counts: DataFrame, by: Sequence[str], seen: DataFrame | None) -> DataFrame:
    exact = F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)
    new = ~F.col("_seen") if seen is not None else F.lit(False)
    return _flag(counts, seen, "_seen", by).groupBy(*by).agg(
        F.sum("n").alias("all_lines"),
        F.sum(exact).alias("exact_lines"),
        F.sum(F.when(new, F.col("n")).otherwise(0)).alias("new_lines"),
        F.sum(F.when(new, exact).otherwise(0)).alias("exact_new"),
    )


def _ground(templates: DataFrame | None) -> str:
    return "gt_present" if templates is None else "ground"


def grouping_accuracy(
    pairs: DataFrame, by: Sequence[str] = (), filter_templates: DataFrame | None = None
) -> DataFrame:
    """GA, PGA, RGA, FGA; with ``filter_templates`` only those truths count."""
    counts = _flag(_stored_counts(pairs, by), filter_templates, "inside", by)
    ground = _ground(filter_templates)
    sums = _combine(
        [*_side_parts(counts, by, filter_templates), _group_part(counts, by)],
        by,
        ["lines", ground, "identified", "ok_lines", "ok_groups"],
    )
    p = F.coalesce(_rate("ok_groups", "identified"), F.lit(0.0))
    r = F.coalesce(_rate("ok_groups", ground), F.lit(0.0))
    return sums.select(
        *by, _rate("ok_lines", "lines").alias("GA"), p.alias("PGA"), r.alias("RGA"), _f1(p, r).alias("FGA")
    )


def template_accuracy(
    pairs: DataFrame,
    by: Sequence[str] = (),
    filter_templates: DataFrame | None = None,
    loose: bool = False,
) -> DataFrame:
    """PTA, RTA, FTA: a predicted template is right if its lines have exactly that one truth."""
    counts = _flag(_stored_counts(pairs, by), filter_templates, "inside", by)
    ground = _ground(filter_templates)
    sums = _combine(
        _side_parts(counts, by, filter_templates, loose), by, [ground, "identified", "ok_templates"]
    )
    p = F.coalesce(_rate("ok_templates", "identified"), F.lit(0.0))
    r = F.coalesce(_rate("ok_templates", ground), F.lit(0.0))
    return sums.select(
        *by,
        F.col("identified").alias("identified_templates"),
        F.col(ground).alias("ground_templates"),
        p.alias("PTA"),
        r.alias("RTA"),
        _f1(p, r).alias("FTA"),
    )


def parsing_accuracy(
    pairs: DataFrame, by: Sequence[str] = (), seen: DataFrame | None = None
) -> DataFrame:
    """PA: share of lines with the exact template; uPA: the same on lines of unseen templates.

    uPA is null without ``seen`` and 0 if no line is unseen.
    """
    part = _line_part(pair_counts(pairs, by), by, seen)
    return part.select(*by, _rate("exact_lines", "all_lines").alias("PA"), _upa(seen).alias("uPA"))


def _upa(seen: DataFrame | None) -> Column:
    if seen is None:
        return F.lit(None).cast("double")
    return F.coalesce(_rate("exact_new", "new_lines"), F.lit(0.0))


def parsing_accuracy_loose(
    pairs: DataFrame, seen: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """PA on the seen rows, with the truth loosened token by token."""
    return _loose_accuracy(pair_counts(pairs, by), seen, by)


def _loose_accuracy(counts: DataFrame, seen: DataFrame | None, by: Sequence[str]) -> DataFrame:
    counts = _flag(counts, seen, "_seen", by).where("_seen")
    ok = F.when(loose_equal(F.col("gt"), F.col("pred")), F.col("n")).otherwise(0)
    return (
        counts.groupBy(*by)
        .agg(F.sum(ok).alias("ok"), F.sum("n").alias("n"))
        .select(*by, _rate("ok", "n").alias("PA_loose"))
    )


def score(
    pairs: DataFrame, by: Sequence[str] = (), seen: DataFrame | None = None, loose: bool = False
) -> DataFrame:
    """All metrics of a parse as one row per ``by``.  With ``loose`` uPA is null."""
    counts = _flag(_stored_counts(pairs, by), None, "inside", by)
    line_part = _line_part(counts, by, None if loose else seen)
    sums = _combine(
        [*_side_parts(counts, by, None, loose), _group_part(counts, by), line_part],
        by,
        ["lines", "gt_present", "identified", "ok_templates", "ok_lines", "ok_groups",
         "all_lines", "exact_lines", "new_lines", "exact_new"],
    )
    zero = F.lit(0.0)
    pga, rga = (F.coalesce(_rate("ok_groups", d), zero) for d in ("identified", "gt_present"))
    pta, rta = (F.coalesce(_rate("ok_templates", d), zero) for d in ("identified", "gt_present"))
    result = sums.select(
        *by,
        F.col("identified").alias("identified_templates"),
        F.col("gt_present").alias("ground_templates"),
        _rate("ok_lines", "lines").alias("GA"),
        _rate("exact_lines", "all_lines").alias("PA"),
        _f1(pga, rga).alias("FGA"),
        _f1(pta, rta).alias("FTA"),
        _upa(None if loose else seen).alias("uPA"),
        pta.alias("PTA"),
        rta.alias("RTA"),
    )
    if not loose:
        return result
    loose_pa = _loose_accuracy(counts, seen, by)
    if by:
        return result.drop("PA").join(loose_pa.withColumnRenamed("PA_loose", "PA"), [*by], "left")
    return result.withColumn("PA", loose_pa.scalar())


def tag_transitions(df: DataFrame, tags: str = "tags") -> DataFrame:
    """Start and bigram probabilities of tag arrays: columns ``prev`` (start, 0, 1), ``tag``, ``p``."""
    t = F.col(tags)
    steps = F.transform(
        t,
        lambda tag, i: F.struct(
            F.when(i == 0, F.lit("start")).otherwise(F.element_at(t, i).cast("string")).alias("prev"),
            tag.cast("string").alias("tag"),
        ),
    )
    # element_at(t, 0) is never reached: the first position takes the other branch
    counts = (
        df.select(F.explode(steps).alias("s"))
        .groupBy("s.prev", "s.tag")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("prev").agg(F.sum("n").alias("total"))
    return counts.join(totals, "prev").select(
        "prev", "tag", "n", (F.col("n") / F.col("total")).alias("p")
    )


def tag_report(df: DataFrame, true_tag: str, pred_tag: str) -> DataFrame:
    """Precision, recall, F1 and support per tag, and the overall accuracy on every row."""
    counts = df.groupBy(F.col(true_tag).alias("t"), F.col(pred_tag).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    per_true = counts.select(F.col("t").alias("tag"), hit.alias("hit"), F.col("n").alias("support"))
    per_pred = counts.select(F.col("p").alias("tag"), F.col("n").alias("predicted"))
    accuracy = counts.agg((F.sum(hit) / F.sum("n")).alias("accuracy")).scalar()
    sums = (
        per_true.unionByName(per_pred, allowMissingColumns=True)
        .groupBy("tag")
        .agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("hit", "support", "predicted")))
    )
    p = F.coalesce(_rate("hit", "predicted"), F.lit(0.0))
    r = F.coalesce(_rate("hit", "support"), F.lit(0.0))
    return sums.select(
        "tag", p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"), "support"
    ).withColumn("accuracy", accuracy)
