"""Mapping cardinality between keys, grain inference and field availability."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from plumbline.functions.columns import (
    DAY_BUCKETS,
    TARGET_BUCKETS,
    bucket,
    bucket_position,
    count_if,
    ratio,
    text,
)
from plumbline.operators.ordered import by_type, cut, histogram_quantiles, take_per_group
from plumbline.operators.rules import FINDING_COLUMNS
from plumbline.operators.skew import heavy_keys
from plumbline.sources.tables import constant_rows

#: rows that a task takes of rows dealt by a key, and the most keys that are looked after one by one
TASK_ROWS, MOST_HEAVY = 250_000, 1000

Pair = tuple[str, str, str]  # name, source column, target column


def pair_rows(df: DataFrame, pairs: list[Pair], as_text: bool = True) -> DataFrame:
    """(pair, source, target) rows of all pairs from one scan, both sides known."""
    cells = {}
    for i, (_, source, target) in enumerate(pairs):
        s, t = F.col(source), F.col(target)
        if as_text:
            s, t = s.cast("string"), t.cast("string")
        cells[f"_{i}"] = F.when(s.isNotNull() & t.isNotNull(), F.struct(s.alias("s"), t.alias("t")))
    long = df.select(*[c.alias(k) for k, c in cells.items()]).unpivot([], list(cells), "_k", "_cell")
    names = F.create_map(*[F.lit(x) for i, p in enumerate(pairs) for x in (f"_{i}", p[0])])
    return long.where(F.col("_cell").isNotNull()).select(
        names[F.col("_k")].alias("pair_name"),
        F.col("_cell.s").alias("source_value"),
        F.col("_cell.t").alias("target_value"),
    )


def source_stats(df: DataFrame, pairs: list[Pair]) -> DataFrame:
    """Rows and distinct targets per (pair, source), keys as text.

    Rows are first merged per (pair, source, target), so one source that holds
    most rows is spread over all tasks by its targets.
    """
    return _count_targets(pair_rows(df, pairs))


def _count_targets(rows: DataFrame) -> DataFrame:
    links = rows.groupBy("pair_name", "source_value", "target_value").agg(F.count(F.lit(1)).alias("n"))
    return links.groupBy("pair_name", "source_value").agg(
        F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("target_distinct_cnt")
    )


def _target_histogram(df: DataFrame, pairs: list[Pair]) -> DataFrame:
    """Sources and rows per (pair, number of targets): few rows however large the data.

    Pairs of equal key types run together with native keys.
    """
    columns = {c: F.col(c) for _, s, t in pairs for c in (s, t)}
    native = {k: (i, c) for i, group in enumerate(by_type(df, columns)) for k, c in group.items()}
    kinds: dict[tuple[int, int], list[Pair]] = {}
    for pair in pairs:
        kinds.setdefault((native[pair[1]][0], native[pair[2]][0]), []).append(pair)
    out = None
    for group in kinds.values():
        casts = {c: native[c][1] for _, s, t in group for c in (s, t)}
        rows = pair_rows(df.select(*[v.alias(c) for c, v in casts.items()]), group, as_text=False)
        hist = _count_targets(rows).groupBy("pair_name", "target_distinct_cnt").agg(
            F.count(F.lit(1)).alias("sources"), F.sum("row_count").alias("rows")
        )
        out = hist if out is None else out.unionByName(hist)
    return out


def mapping_summary(df: DataFrame, pairs: list[Pair]) -> DataFrame:
    """How many targets the sources of each pair have: mean, p50, p90, max, multi-mapped share."""
    hist = _target_histogram(df, pairs)
    cnt, sources = F.col("target_distinct_cnt"), F.col("sources")
    w = Window.partitionBy("pair_name")
    running = w.orderBy("target_distinct_cnt").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumns({"_cum": F.sum(sources).over(running), "_all": F.sum(sources).over(w)})

    def quantile(p: float) -> Column:
        return F.min(F.when(F.col("_cum") >= F.col("_all") * p - F.lit(1e-9), cnt))

    stats = hist.groupBy("pair_name").agg(
        F.sum(sources).alias("source_key_count"),
        F.sum("rows").alias("covered_rows"),
        F.sum(cnt * sources).alias("_targets"),
        quantile(0.5).alias("p50_target_per_source"),
        quantile(0.9).alias("p90_target_per_source"),
        F.max(cnt).alias("max_target_per_source"),
        F.coalesce(F.sum(F.when(cnt > 1, sources)), F.lit(0)).alias("multi_mapping_source_keys"),
    )
    keys = F.col("source_key_count")
    return stats.select(
        "pair_name",
        "source_key_count",
        "covered_rows",
        ratio(F.col("_targets"), keys, 4).alias("avg_target_per_source"),
        "p50_target_per_source",
        "p90_target_per_source",
        "max_target_per_source",
        "multi_mapping_source_keys",
        ratio(F.col("multi_mapping_source_keys"), keys).alias("multi_mapping_ratio"),
    )


def mapping_buckets(df: DataFrame, pairs: list[Pair], day_pairs: list[str] | None = None) -> DataFrame:
    """Sources per bucket of target counts; ``day_pairs`` use the day buckets."""
    cnt = F.col("target_distinct_cnt")
    is_day = F.col("pair_name").isin(day_pairs or [])
    label = F.when(is_day, bucket(cnt, DAY_BUCKETS)).otherwise(bucket(cnt, TARGET_BUCKETS))
    out = (
        _target_histogram(df, pairs)
        .groupBy("pair_name", label.alias("target_bucket"))
        .agg(F.sum("sources").alias("source_key_count"))
    )
    position = F.when(
        F.col("pair_name").isin(day_pairs or []), bucket_position("target_bucket", DAY_BUCKETS)
    ).otherwise(bucket_position("target_bucket", TARGET_BUCKETS))
    all_keys = F.sum("source_key_count").over(Window.partitionBy("pair_name"))
    return out.withColumns(
        {"source_key_ratio": ratio(F.col("source_key_count"), all_keys), "bucket_order": position}
    )


def mapping_samples(
    df: DataFrame, pairs: list[Pair], n: int = 20, targets: int = 5, separator: str = " | "
) -> DataFrame:
    """Sources with the most targets, with the first targets in order.

    Only the chosen sources (n per pair) are joined back, and per source only
    the first ``targets`` values are collected.
    """
    top = take_per_group(
        source_stats(df, pairs).where("target_distinct_cnt > 1"),
        ["pair_name"],
        [F.desc("target_distinct_cnt"), F.desc("row_count"), F.asc("source_value")],
        n,
    )
    links = pair_rows(df, pairs).join(
        F.broadcast(top.select("pair_name", "source_value")), ["pair_name", "source_value"], "left_semi"
    )
    first = take_per_group(
        links.distinct(), ["pair_name", "source_value"], [F.asc("target_value")], targets
    )
    texts = first.groupBy("pair_name", "source_value").agg(
        F.array_join(F.sort_array(F.collect_list("target_value")), separator).alias("target_samples")
    )
    return top.join(texts, ["pair_name", "source_value"])


def mapping_range_samples(df: DataFrame, pairs: list[Pair], n: int = 20) -> DataFrame:
    """Sources with the most targets, with their smallest and largest target."""
    links = pair_rows(df, pairs).groupBy("pair_name", "source_value", "target_value").agg(
        F.count(F.lit(1)).alias("n")
    )
    stats = links.groupBy("pair_name", "source_value").agg(
        F.sum("n").alias("row_count"),
        F.count(F.lit(1)).alias("target_distinct_cnt"),
        F.concat_ws(" | ", F.min("target_value"), F.max("target_value")).alias("target_samples"),
    )
    order = [F.desc("target_distinct_cnt"), F.desc("row_count"), F.asc("source_value")]
    return take_per_group(stats.where("target_distinct_cnt > 1"), ["pair_name"], order, n)


def pair_frequency(df: DataFrame, source: str, target: str, n: int = 20) -> DataFrame:
    """Most frequent (source, target) pairs, both sides known."""
    known = df.where(F.col(source).isNotNull() & F.col(target).isNotNull())
    counts = known.groupBy(F.col(source).alias("source_value"), F.col(target).alias("target_value")).agg(
        F.count(F.lit(1)).alias("row_count")
    )
    return counts.orderBy(F.desc("row_count"), "source_value", "target_value").limit(n)


def mapping_checks(
    df: DataFrame, pairs: list[Pair], day_pairs: list[str] | None = None, quick: bool = False
) -> dict[str, DataFrame]:
    """Summary, buckets and samples of every pair whose two columns exist."""
    bound = [p for p in pairs if p[1] in df.columns and p[2] in df.columns]
    out = {"summary": mapping_summary(df, bound)}
    if not quick:
        out["buckets"] = mapping_buckets(df, bound, day_pairs)
        out["samples"] = mapping_samples(df, bound)
    return out


def mapping_findings(summary: DataFrame, max_targets: dict[str, int] | None = None, scope: str = "") -> DataFrame:
    """Findings for multi-mapped pairs and for sources with too many targets."""
    multi = summary.where("multi_mapping_source_keys > 0").select(
        F.concat(F.col("pair_name"), F.lit(" is not unique")).alias("check"),
        "multi_mapping_source_keys",
        "multi_mapping_ratio",
        F.concat_ws(
            "", F.lit("max targets per source: "), F.col("max_target_per_source").cast("string")
        ).alias("detail"),
    )
    limit = F.lit(None).cast("int")
    for name, top in (max_targets or {}).items():
        limit = F.when(F.col("pair_name") == name, F.lit(top)).otherwise(limit)
    wide = summary.where(F.col("max_target_per_source") > limit).select(
        F.concat(F.col("pair_name"), F.lit(" has sources with many targets")).alias("check"),
        "multi_mapping_source_keys",
        "multi_mapping_ratio",
        F.concat_ws(
            "", F.lit("max targets per source: "), F.col("max_target_per_source").cast("string")
        ).alias("detail"),
    )
    return (
        multi.unionByName(wide)
        .select(
            "check",
            F.lit(scope).alias("scope"),
            F.lit("medium").alias("severity"),
            F.lit("fail").alias("status"),
            F.col("multi_mapping_source_keys").alias("row_count"),
            F.round(F.col("multi_mapping_ratio") * 100.0, 4).alias("row_rate_pct"),
            F.lit("wrong_grain").alias("bucket"),
            "detail",
            F.array().cast("array<string>").alias("sample"),
        )
        .select(*FINDING_COLUMNS)
    )


def grain_candidates(columns: list[str], candidates: list[list[str]]) -> list[list[str]]:
    """Candidate key lists whose columns all exist, in their order."""
    return [keys for keys in candidates if set(keys) <= set(columns)]


def sets_by_column(sets: dict[int, list[str]]) -> dict[str | None, dict[int, list[str]]]:
    """Key lists by a column that several of them share, the most shared ones first; those that share none under None."""
    out, left = {}, dict(sets)
    while left or not out:
        counts = Counter(c for keys in left.values() for c in keys)
        column, n = max(counts.items(), key=lambda x: x[1], default=(None, 0))
        if n < 2:
            out[None] = left
            break
        out[column] = {gid: keys for gid, keys in left.items() if column in keys}
        left = {gid: keys for gid, keys in left.items() if column not in keys}
    return out


def dealt_by(rows: DataFrame, column: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows dealt by a column, rows whose value there has too many of them for one task); None for a part without rows."""
    total = rows.count()
    parts = max(1, -(-total // TASK_ROWS))
    if parts == 1:
        return rows.repartition(1, column), None
    share = 1 / min(parts, MOST_HEAVY)
    heavy = cut(heavy_keys(rows, column, share).withColumnRenamed(column, "_heavy"))
    if heavy.isEmpty():
        return rows.repartition(parts, column), None
    match = F.col(column).eqNullSafe(F.col("_heavy"))
    light = rows.join(F.broadcast(heavy), match, "left_anti")
    return light.repartition(parts, column), rows.join(F.broadcast(heavy), match, "left_semi")


def distinct_where_they_lie(dealt: DataFrame, column: str, sets: dict[int, list[str]], groups: list[str]) -> DataFrame:
    """(_gid, keys, values): distinct values per key of several key lists, from rows dealt by a column that all have; no shuffle."""
    each = dealt.withColumn("_gid", F.explode(F.array(*[F.lit(gid).cast("long") for gid in sets])))
    cells = {c: F.when(F.col("_gid").isin([gid for gid, keys in sets.items() if c in keys]), F.col(c)) for c in groups if c != column}
    kept = each.select("_gid", column, *[c.alias(name) for name, c in cells.items()], "_value").distinct()
    return kept.groupBy("_gid", *groups).agg(F.count(F.lit(1)).alias("values"))


def grain_inference(df: DataFrame, field: str, candidates: list[list[str]]) -> DataFrame:
    """Test key lists as the grain of a field; the first with one value per key wins.

    All lists are told apart by a number with a bit for each absent column,
    because keys themselves may be NULL. Lists that share a column are tested
    together: rows are dealt by it once, and all that is distinct is found where
    they lie. Values of that column that are too frequent for one task, and
    lists that share none, go by grouping sets.
    """
    usable = grain_candidates(df.columns, candidates)
    names = list(dict.fromkeys(k for keys in usable for k in keys))
    alias = {k: f"_k{i}" for i, k in enumerate(names)}
    def plain(c: str) -> Column:
        return text(c) if isinstance(df.schema[c].dataType, StringType) else F.col(c)

    base = df.where(F.col(field).isNotNull()).select(
        *[plain(k).alias(alias[k]) for k in names], plain(field).alias("_value")
    )
    ids, sets = {}, {}
    for keys in usable:
        absent = [0 if k in keys else 1 for k in names] + [0]
        gid = reduce(lambda acc, bit: acc * 2 + bit, absent, 0)
        ids["+".join(keys)] = gid
        sets[gid] = [alias[k] for k in names if k in keys]
    groups = [*alias.values()]
    combos = None
    for shared, some in sets_by_column(sets).items():
        dealt, rest = (None, base) if shared is None else dealt_by(base, shared)
        parts = [] if dealt is None else [distinct_where_they_lie(dealt, shared, some, groups)]
        if rest is not None:
            grouped = [[F.col(c) for c in [*keys, "_value"]] for keys in some.values()]
            by_sets = rest.groupingSets(grouped, *[F.col(g) for g in [*groups, "_value"]]).agg(F.grouping_id().cast("long").alias("_gid"))
            parts.append(by_sets.groupBy("_gid", *groups).agg(F.count(F.lit(1)).alias("values")))
        for part in parts:
            counts = part.groupBy("_gid", "values").agg(F.count(F.lit(1)).alias("keys"))
            combos = counts if combos is None else combos.unionByName(counts)
    hist = combos.groupBy("_gid", "values").agg(F.sum("keys").alias("keys"))
    totals = hist.groupBy("_gid").agg(
        F.sum("keys").alias("key_count"), F.max("values").alias("max_distinct_per_key")
    )
    quantiles = histogram_quantiles(
        hist, ["_gid"], "values", "keys", {"p50_distinct_per_key": 0.5, "p90_distinct_per_key": 0.9}
    )
    labels = [(gid, name, i + 1) for i, (name, gid) in enumerate(ids.items())]
    named = constant_rows(df.sparkSession, labels, "_gid long, grain string, position int")
    out = totals.join(quantiles, "_gid").join(F.broadcast(named), "_gid").drop("_gid")
    first = Window.partitionBy(F.lit(1))
    ok = F.when(F.col("max_distinct_per_key") == 1, F.col("position"))
    return out.select(
        F.lit(field).alias("field_name"),
        "grain",
        "position",
        "key_count",
        "max_distinct_per_key",
        "p50_distinct_per_key",
        "p90_distinct_per_key",
        F.coalesce(F.col("position") == F.min(ok).over(first), F.lit(False)).alias("is_minimal_grain"),
    )


def resolve_field(
    tables: dict[str, list[str]],
    table: str,
    exact: list[str] | None = None,
    approx: list[str] | None = None,
    fallback: list[tuple[str, list[str]]] | None = None,
    components: list[str] | None = None,
    derived: str | None = None,
) -> tuple[str, str | None, str | None]:
    """Where a wanted field can come from: (status, table, column or formula)."""
    if table not in tables:
        return "table_not_found", None, None
    columns = set(tables[table])

    def first(options: list[str] | None, present: set[str]) -> str | None:
        return next((c for c in options or [] if c in present), None)

    hit = first(exact, columns)
    if hit:
        return "exact", table, hit
    for other, options in fallback or []:
        hit = first(options, set(tables.get(other, [])))
        if hit:
            return "fallback", other, hit
    if derived:
        missing = [c for c in components or [] if c not in columns]
        return ("missing", table, None) if missing else ("derived", table, derived)
    hit = first(approx, columns)
    return ("approx_only", table, hit) if hit else ("missing", table, None)


def field_availability(
    frames: dict[str, DataFrame], specs: list[dict], grains: dict[str, list[list[str]]] | None = None
) -> DataFrame:
    """Status, source and minimal grain of every wanted field.

    Each spec holds ``name``, ``table`` and any of ``exact``, ``approx``,
    ``fallback``, ``components`` and ``derived``.
    """
    tables = {name: df.columns for name, df in frames.items()}
    rows, out = [], None
    for spec in specs:
        options = {k: v for k, v in spec.items() if k != "name"}
        status, table, column = resolve_field(tables, **options)
        rows.append((spec["name"], status, table, column))
    spark = next(iter(frames.values())).sparkSession
    schema = "field_name string, status string, source_table string, source_column string"
    base = constant_rows(spark, rows, schema)
    for table, column in dict.fromkeys((r[2], r[3]) for r in rows if r[1] in ("exact", "fallback", "approx_only")):
        lists = grain_candidates(frames[table].columns, (grains or {}).get(table, []))
        if not lists:
            continue
        best = grain_inference(frames[table], column, lists).where("is_minimal_grain").select(
            F.lit(table).alias("source_table"), F.lit(column).alias("source_column"), "grain", "key_count"
        )
        out = best if out is None else out.unionByName(best)
    if out is None:
        return base.withColumns(
            {"grain": F.lit(None).cast("string"), "key_count": F.lit(None).cast("long")}
        )
    return base.join(out, ["source_table", "source_column"], "left")


def ratio_metric(
    df: DataFrame, numerator: str, denominator: str, by: list[str] | None = None, name: str = "ratio", decimals: int = 6
) -> DataFrame:
    """sum(numerator) / sum(denominator), NULL when the denominator sums to zero."""
    value = F.round(F.try_divide(F.sum(numerator), F.sum(denominator)), decimals).alias(name)
    return df.groupBy(*by).agg(value) if by else df.agg(value)


def empty_key_findings(df: DataFrame, key: str, scope: str = "") -> DataFrame:
    """A finding when a key column has no usable value at all."""
    one = df.agg(F.count(F.lit(1)).alias("n"), count_if(F.col(key).isNotNull()).alias("filled"))
    return one.where("filled = 0").select(
        F.lit(f"{key} has no usable value").alias("check"),
        F.lit(scope).alias("scope"),
        F.lit("high").alias("severity"),
        F.lit("fail").alias("status"),
        F.col("n").alias("row_count"),
        F.lit(100.0).alias("row_rate_pct"),
        F.lit("bridge_key_missing").alias("bucket"),
        F.lit("").alias("detail"),
        F.array().cast("array<string>").alias("sample"),
    )
