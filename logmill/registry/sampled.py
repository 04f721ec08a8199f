"""Cleaning, clustering and sampling of document lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import clusters, sampling
from ..plans import fixtures
from ..session import materialize
from ..sources.raw import head_fraction, limit_lines
from . import sql
from .core import query

_SHOTS = [8, 16, 32, 64, 128, 256]
_SEED = 7


def _clustered(body: str, *more: str) -> str:
    return sql.on_docs(body, sql.CLUSTERS, *more)


@query(
    "distinct_pairs", sql.on_docs("SELECT DISTINCT log, label FROM doc_labelled")
)
def distinct_pairs(spark, sf_dir):
    return clusters.distinct_pairs(fixtures.doc_labelled(spark, sf_dir))


@query("nonempty_clean", _clustered("SELECT log, label, clean FROM lines"))
def nonempty_clean(spark, sf_dir):
    pairs = clusters.distinct_pairs(fixtures.doc_labelled(spark, sf_dir))
    return clusters.nonempty_clean(pairs)


@query("vocabulary", _clustered("SELECT token, n FROM vocab"))
def vocabulary(spark, sf_dir):
    pairs = clusters.distinct_pairs(fixtures.doc_labelled(spark, sf_dir))
    return clusters.vocabulary(clusters.nonempty_clean(pairs))


@query("topk_tokens", _clustered("SELECT DISTINCT clean, coarse AS tokens FROM clustered"))
def topk_tokens(spark, sf_dir):
    pool = clusters.nonempty_clean(clusters.distinct_pairs(fixtures.doc_labelled(spark, sf_dir)))
    return clusters.topk_tokens(pool, 3).select("clean", F.array_join("tokens", " ").alias("tokens"))


@query(
    "coarse_fine_clusters",
    _clustered(
        """SELECT coarse, fine, fine_size, CAST(sum(fine_size) OVER (PARTITION BY coarse) AS BIGINT) AS coarse_size
        FROM sizes"""
    ),
)
def coarse_fine_clusters(spark, sf_dir):
    return clusters.cluster_sizes(clusters.cluster_lines(fixtures.doc_labelled(spark, sf_dir)))


_ROUND_ROBIN = f"""
draw1 AS (SELECT *, row_number() OVER (PARTITION BY coarse, fine
    ORDER BY md5('{_SEED}|' || log || '|' || label), log, label) AS r1 FROM clustered),
draw2 AS (SELECT *, row_number() OVER (PARTITION BY coarse ORDER BY r1, fine_size DESC, fine) AS r2
          FROM draw1 JOIN sizes USING (coarse, fine)),
draw3 AS (SELECT *, row_number() OVER (ORDER BY r2, md5('{_SEED}|' || coarse), coarse) AS r3 FROM draw2)"""
_SHOT_LIST = ", ".join(f"({k})" for k in _SHOTS)


@query(
    "stratified_sample",
    _clustered(
        f"SELECT shot, log, label FROM draw3 JOIN (VALUES {_SHOT_LIST}) s(shot) ON r3 <= shot",
        _ROUND_ROBIN,
    ),
)
def stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(fixtures.doc_labelled(spark, sf_dir), _SHOTS, _SEED)


@query(
    "stratified_sample_independent",
    _clustered(
        """SELECT shot, log, label FROM i3 WHERE r3 <= shot""",
        f"""i1 AS (SELECT *, row_number() OVER (PARTITION BY shot, coarse, fine
            ORDER BY md5('{_SEED}|' || shot || '|' || log || '|' || label), log, label) AS r1
          FROM clustered, (VALUES (8), (32)) s(shot)),
        i2 AS (SELECT *, row_number() OVER (PARTITION BY shot, coarse ORDER BY r1, fine_size DESC, fine) AS r2
          FROM i1 JOIN sizes USING (coarse, fine)),
        i3 AS (SELECT *, row_number() OVER (PARTITION BY shot
            ORDER BY r2, md5('{_SEED}|' || shot || '|' || coarse), coarse) AS r3 FROM i2)""",
    ),
)
def stratified_sample_independent(spark, sf_dir):
    return sampling.stratified_sample(
        fixtures.doc_labelled(spark, sf_dir), [8, 32], _SEED, independent=True
    )


_COARSE = "coarse_sizes AS (SELECT coarse, count(*) AS size FROM clustered GROUP BY coarse)"


@query(
    "quota_coarse",
    # with more clusters than places, the first ones in order get one place each
    _clustered(
        f"""SELECT shot, coarse, 1 AS quota FROM (
          SELECT coarse, row_number() OVER (ORDER BY md5('{_SEED}|' || coarse), coarse) AS place FROM coarse_sizes)
        JOIN (VALUES {_SHOT_LIST}) s(shot) ON place <= shot""",
        _COARSE,
    ),
)
def quota_coarse(spark, sf_dir):
    sizes = clusters.cluster_sizes(clusters.cluster_lines(fixtures.doc_labelled(spark, sf_dir)))
    order = [sampling.shuffled(_SEED, "coarse"), F.col("coarse")]
    return sampling.coarse_quotas(sizes, _SHOTS, order)


@query(
    "quota_fine",
    # the clusters are larger than their places, so one pass of equal shares hands out all
    sql.on_events(
        """SELECT shot, coarse, fine, q // m + CASE WHEN p <= q % m THEN 1 ELSE 0 END AS quota
        FROM (SELECT *, count(*) OVER (PARTITION BY shot, coarse) AS m FROM fine_places WHERE p <= q)""",
        """component_sizes AS (SELECT "Component" AS coarse, "EventId" AS fine, count(*) AS n FROM event_log GROUP BY ALL),
        coarse_places AS (SELECT shot, coarse, row_number() OVER (PARTITION BY shot ORDER BY coarse) AS p,
            count(*) OVER (PARTITION BY shot) AS m
          FROM (SELECT DISTINCT coarse FROM component_sizes), (VALUES (12), (40)) s(shot)),
        fine_places AS (SELECT shot, coarse, fine, shot // m + CASE WHEN c.p <= shot % m THEN 1 ELSE 0 END AS q,
            row_number() OVER (PARTITION BY shot, coarse ORDER BY n DESC, fine) AS p
          FROM component_sizes JOIN coarse_places c USING (coarse))""",
    ),
)
def quota_fine(spark, sf_dir):
    """Places for 12 and for 40 lines over components, inside them over event types."""
    lines = fixtures.event_log(spark, sf_dir).select(
        F.col("Component").alias("coarse"), F.col("EventId").alias("fine")
    )
    sizes = clusters.cluster_sizes(lines)
    quotas = sampling.coarse_quotas(sizes, [12, 40], [F.col("coarse")])
    return sampling.fine_quotas(sizes, quotas).where("quota > 0")


_POOL = "pool_lines AS (SELECT DISTINCT log, label FROM lines)"


def _checked(picks, pool, *by):
    """Size of each sample, its distinct lines, and whether all of them come from the pool."""
    picks = materialize(picks)  # at most a few hundred rows
    # only lines that were picked are looked for in the pool
    wanted = pool.select("log", "label").join(F.broadcast(picks.select("log", "label").distinct()), ["log", "label"], "left_semi")
    known = wanted.distinct().withColumn("_known", F.lit(True))
    joined = picks.join(known, ["log", "label"], "left")
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("log", "label").alias("n_lines"),
        F.bool_and(F.coalesce("_known", F.lit(False))).alias("known"),
    )


_SIZES = f"""SELECT shot, CAST(least(shot, (SELECT count(*) FROM pool_lines)) AS BIGINT) AS n,
  CAST(least(shot, (SELECT count(*) FROM pool_lines)) AS BIGINT) AS n_lines, true AS known FROM (VALUES {_SHOT_LIST}) s(shot)"""


@query("stratified_passes_sizes", _clustered(_SIZES, _POOL))
def stratified_passes_sizes(spark, sf_dir):
    """Every sample of the quota mode is full, and its lines are distinct lines of the pool."""
    docs = fixtures.doc_labelled(spark, sf_dir)
    picks = sampling.stratified_sample(docs, _SHOTS, _SEED, quota="reference")
    return _checked(picks, clusters.nonempty_clean(clusters.distinct_pairs(docs)), "shot")


@query("cluster_adaptive_sizes", _clustered("SELECT 64 AS n, 64 AS n_lines, true AS known"))
def cluster_adaptive_sizes(spark, sf_dir):
    docs = fixtures.doc_labelled(spark, sf_dir)
    picks = sampling.cluster_adaptive_sample(docs, 64, 8, _SEED)
    return _checked(picks, clusters.nonempty_clean(clusters.distinct_pairs(docs)))


@query(
    "adaptive_sample_prefixes",
    sql.on_docs(
        r"""SELECT shot, shot AS n, 1 AS first_pick, shot AS last_pick, shot AS n_lines,
          (SELECT max(len(list_filter(string_split_regex(trim(log), '\s+'), lambda w: w <> ''))) FROM doc_labelled) AS first_words
        FROM (VALUES (8), (16), (32), (64), (128), (256)) s(shot)"""
    ),
)
def adaptive_sample_prefixes(spark, sf_dir):
    """Samples are full prefixes 1, 2, … of one order of distinct lines that begins with a line of most words."""
    picks = sampling.adaptive_sample(fixtures.doc_labelled(spark, sf_dir), _SHOTS, 32, _SEED)
    first = F.when(F.col("pick") == 1, F.size(words(F.col("log"))))
    return picks.groupBy("shot").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("pick").alias("first_pick"),
        F.max("pick").alias("last_pick"),
        F.countDistinct("log", "label").alias("n_lines"),
        F.max(first).alias("first_words"),
    )


@query("stratified_sample_passes")
def stratified_sample_passes(spark, sf_dir):
    return sampling.stratified_sample(
        fixtures.doc_labelled(spark, sf_dir), _SHOTS, _SEED, quota="reference"
    )


def _greedy(pool: str, n_candidate: int) -> tuple[str, ...]:
    """The sequential draw over ``pool`` (grp, log, label, k): one step of the recursion is one pick in every group."""
    order = f"md5('{_SEED}|' || log || '|' || label)"
    return (
        f"""greedy_pool AS MATERIALIZED ({pool})""",
        f"""sized AS (SELECT *, {sql.word_list('log')} AS w, {order} AS place,
            1 + CAST('0x' || substr(md5('{_SEED}|' || label || '|' || log), 1, 8) AS BIGINT) % greatest(k - 1, 1) AS round FROM greedy_pool),
        starts AS (SELECT * FROM sized
          QUALIFY row_number() OVER (PARTITION BY grp ORDER BY len(w) DESC, length(log) DESC, log DESC, label DESC) = 1),
        drawn AS (SELECT * FROM sized QUALIFY row_number() OVER (PARTITION BY grp, round ORDER BY place, log, label) <= {n_candidate}),
        candidates AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round, place) - 1 AS pos FROM (
          SELECT grp, log, label, k, w, place, 0 AS round FROM starts
          UNION ALL SELECT grp, log, label, k, w, place, round FROM drawn ANTI JOIN starts USING (grp, log, label))),
        bags AS MATERIALIZED (SELECT grp, pos, word, count(*) AS n
          FROM (SELECT grp, pos, unnest(w) AS word FROM candidates) GROUP BY ALL),
        picks AS (
          SELECT 1 AS step, grp, pos, k, round, length(log) AS chars, len(w) AS total, 1e300::DOUBLE AS near, pos = 0 AS pick, false AS used
          FROM candidates
          UNION ALL
          SELECT step, grp, pos, k, round, chars, total, near,
            row_number() OVER (PARTITION BY grp ORDER BY able DESC, near DESC, chars DESC, pos) = 1 AND able AS pick, used
          FROM (SELECT *, NOT used AND (own OR spare <= {n_candidate} - n_own) AS able
            FROM (SELECT *, sum(CASE WHEN own AND NOT used THEN 1 ELSE 0 END) OVER (PARTITION BY grp) AS n_own,
                row_number() OVER (PARTITION BY grp ORDER BY used OR own, pos) AS spare
              FROM (SELECT r.step + 1 AS step, r.grp, r.pos, r.k, r.round, r.chars, r.total, r.used OR r.pick AS used, r.round = r.step AS own,
                  least(r.near, CASE WHEN r.total + p.total = 0 THEN 0 ELSE 1 - coalesce(o, 0)::DOUBLE / (r.total + p.total - coalesce(o, 0)) END) AS near
                FROM picks r JOIN (SELECT grp, total FROM picks WHERE pick) p USING (grp)
                LEFT JOIN (SELECT b.grp, b.pos, sum(least(b.n, q.n)) AS o FROM picks s JOIN bags q USING (grp, pos)
                  JOIN bags b ON b.grp = q.grp AND b.word = q.word WHERE s.pick GROUP BY b.grp, b.pos) shared USING (grp, pos)
                WHERE r.step < r.k))))""",
    )


def _sampled(body: str, pool: str, n_candidate: int, *more: str) -> str:
    return sql.on_docs(body, *more, *_greedy(pool, n_candidate)).replace("WITH", "WITH RECURSIVE", 1)


# without SQL: 256 steps over all candidates are too much for one recursion; the next two draw in the same way
@query("adaptive_sample")
def adaptive_sample(spark, sf_dir):
    return sampling.adaptive_sample(fixtures.doc_labelled(spark, sf_dir), _SHOTS, 32, _SEED)


@query(
    "adaptive_sample_by_source",
    _sampled(
        """SELECT log, label, grp AS "Dataset", step AS pick, shot FROM picks JOIN candidates USING (grp, pos)
        JOIN (VALUES (8), (16)) s(shot) ON step <= shot WHERE pick""",
        "SELECT label AS grp, log, label, 16 AS k FROM (SELECT DISTINCT log, label FROM doc_labelled)",
        32,
    ),
)
def adaptive_sample_by_source(spark, sf_dir):
    rows = fixtures.doc_labelled(spark, sf_dir).withColumn("Dataset", F.col("label"))
    return sampling.adaptive_sample(rows, [8, 16], 32, _SEED, by=["Dataset"])


@query(
    "cluster_adaptive_sample",
    # more clusters than places: the 64 largest have one each
    _sampled(
        "SELECT grp AS coarse, log, label, step AS pick FROM picks JOIN candidates USING (grp, pos) WHERE pick",
        """SELECT coarse AS grp, log, label, 1 AS k FROM clustered JOIN (
          SELECT coarse, count(*) AS size FROM clustered GROUP BY coarse ORDER BY size DESC, coarse LIMIT 64) USING (coarse)""",
        8,
        sql.CLUSTERS,
    ),
)
def cluster_adaptive_sample(spark, sf_dir):
    return sampling.cluster_adaptive_sample(fixtures.doc_labelled(spark, sf_dir), 64, 8, _SEED)


@query(
    "head_fraction",
    sql.on_events(
        """SELECT "LineId", "Content", "EventTemplate" FROM event_log
        WHERE "LineId" <= (SELECT floor(0.2 * count(*)) FROM event_log)"""
    ),
)
def first_fifth(spark, sf_dir):
    log = fixtures.event_log(spark, sf_dir).select("LineId", "Content", "EventTemplate")
    return head_fraction(log, 0.2)


@query(
    "limit_lines",
    sql.on_events('SELECT "LineId", "Content" FROM event_log ORDER BY "LineId" LIMIT 500'),
)
def first_lines(spark, sf_dir):
    return limit_lines(fixtures.event_log(spark, sf_dir).select("LineId", "Content"), 500)
