"""Keys: uniqueness, resume by anti-join, reconciliation of expected and observed rows, and leakage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import durable


class CheckFailed(ValueError):
    """A gate found violations."""


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, n, reason`` for each key that is null in a part or stands more than once."""
    null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"))
    reason = F.when(null, "null").when(F.col("n") > 1, "duplicate")
    return counted.withColumn("reason", reason).where("reason is not null")


def unique_index(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` itself, or ``CheckFailed`` if its keys are not unique and whole."""
    bad = key_violations(df, keys).limit(5).collect()
    if bad:
        raise CheckFailed(f"keys {list(keys)}: {bad}")
    return df


#: Keys that are sent to every task to mark rows; more are met by a shuffled join.
SENT_KEYS = 500_000


def alone_and_shared(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key (null is one) no other row has, and the others, or none where there are none. Only the keys are shuffled."""
    found = durable(df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1").select("_key"))
    n = found.count()
    if n == 0:
        return df, None
    found = F.broadcast(found) if n <= SENT_KEYS else found
    same = F.col(key).eqNullSafe(F.col("_key"))
    return df.join(found, same, "left_anti"), df.join(found, same, "left_semi")


def done_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def pending(jobs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jobs without a row in ``done``; null key parts match each other."""
    return null_safe_join(jobs, done_keys(done, keys), keys, "left_anti")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Semi and anti joins in which nulls are equal."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys])
    return left.join(r, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys)), how)


def reconcile(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows and keys of both, missing, extra and duplicate keys, and ``ok`` if the two agree exactly.

    Both sides are counted by key before they meet, so that the join sees each key once.
    """
    e = expected.groupBy(*keys).agg(F.count("*").alias("n_e"))
    o = observed.groupBy(*keys).agg(F.count("*").alias("n_o"))
    both = e.join(o, list(keys), "full")
    out = both.agg(
        F.coalesce(F.sum("n_e"), F.lit(0)).cast("long").alias("expected_rows"),
        F.coalesce(F.sum("n_o"), F.lit(0)).cast("long").alias("observed_rows"),
        F.count_if(F.col("n_o").isNull()).alias("missing"),
        F.count_if(F.col("n_e").isNull()).alias("extra"),
        F.count_if(F.col("n_o") > 1).alias("duplicates"),
    )
    ok = "missing = 0 and extra = 0 and duplicates = 0 and expected_rows = observed_rows"
    return out.withColumn("ok", F.expr(ok))


def require_reconciled(expected: DataFrame, observed: DataFrame, keys: Sequence[str], allow_missing: bool = False) -> None:
    """Raise unless ``reconcile`` is ok; before a run, missing rows may be allowed."""
    r = reconcile(expected, observed, keys).first()
    if not (r.ok or allow_missing and not r.extra and not r.duplicates):
        raise CheckFailed(str(r))


def missing_conditions(df: DataFrame, col: str, required: Sequence[str]) -> DataFrame:
    """Required values of a column that no row has."""
    want = df.sparkSession.createDataFrame([(x,) for x in required], f"{col} string")
    return want.join(df.select(col).distinct(), col, "left_anti")


def split_leakage(df: DataFrame, split_col: str, values: Sequence[str]) -> DataFrame:
    """``kind, left_split, right_split, overlap``: distinct values of each column that two splits share.

    A value's splits are gathered by one aggregate per column (there are few splits), never by a
    self-join of the rows.
    """
    parts = []
    for v in values:
        per = df.where(F.col(v).isNotNull()).groupBy(v).agg(F.array_sort(F.collect_set(split_col)).alias("s"))
        pairs = per.where(F.size("s") > 1).select(
            F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("l"), b.alias("r")))))).alias("p")
        )
        parts.append(pairs.groupBy(F.lit(v).alias("kind"), F.col("p.l").alias("left_split"), F.col("p.r").alias("right_split")).agg(F.count("*").alias("overlap")))
    return reduce(DataFrame.unionByName, parts)


def completeness(expected: DataFrame, labels: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """``head, expected, labelled, missing`` for each label table."""
    parts = []
    for head, df in labels.items():
        met = expected.select(*keys).distinct().join(df.select(*keys, F.lit(1).alias("_has")).distinct(), list(keys), "left")
        parts.append(met.agg(F.lit(head).alias("head"), F.count("*").alias("expected"), F.count("_has").alias("labelled")))
    return reduce(DataFrame.unionByName, parts).withColumn("missing", F.col("expected") - F.col("labelled"))


def rule_violations(df: DataFrame, key: Column, rules: dict[str, Column], detail: Column | None = None) -> DataFrame:
    """``rule, key, detail`` for each row that breaks a named rule (a rule that is null is broken)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    note = F.lit(None).cast("string") if detail is None else detail.cast("string")
    return df.select(F.explode(broken).alias("rule"), key.cast("string").alias("key"), note.alias("detail"))


def require_valid(violations: DataFrame) -> None:
    bad = violations.limit(10).collect()
    if bad:
        raise CheckFailed(str(bad))


def same_set(a: Column, b: Column) -> Column:
    """Arrays of the same members, each once."""
    return (F.array_sort(a) == F.array_sort(b)) & (F.size(a) == F.size(F.array_distinct(a)))


def inconsistent_groups(df: DataFrame, group: Sequence[str], same: Sequence[str]) -> DataFrame:
    """Groups whose rows don't agree on the columns ``same``, nulls being equal to each other."""
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*same)).alias("variants")).where("variants > 1")


def opaque_ids(df: DataFrame, group: Sequence[str], order: Sequence[str], prefix: str) -> DataFrame:
    """Number the rows of each group in order as ``prefix_000`` and so on, from zero."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1
    return df.withColumn("opaque_id", F.concat(F.lit(prefix + "_"), F.lpad(n.cast("string"), 3, "0")))


def forbidden_fields(df: DataFrame, json_col: str, id_col: str, tokens: Sequence[str]) -> DataFrame:
    """``id_col, field``: keys of a JSON object, at any depth, with a forbidden token in the name.

    Strings are read from left to right, so that text in a value is no key, and those before a colon kept.
    """
    strings = F.regexp_extract_all(json_col, F.lit(r'"(?:[^"\\]|\\.)*"\s*:?'), F.lit(0))
    names = F.transform(F.filter(strings, lambda s: s.endswith(":")), lambda s: F.regexp_extract(s, r'^"(.*)"\s*:$', 1))
    hit = F.filter(names, lambda s: F.lower(s).rlike("|".join(tokens)))
    return df.select(id_col, F.explode(hit).alias("field"))


def schema_fields(df: DataFrame, tokens: Sequence[str]) -> list[str]:
    """Dotted names of a frame's own fields, nested ones too, that contain a forbidden token."""
    out: list[str] = []

    def walk(kind, at: str) -> None:
        for f in getattr(kind, "fields", []):
            name = f"{at}.{f.name}" if at else f.name
            if any(t in f.name.lower() for t in tokens):
                out.append(name)
            inner = f.dataType
            while hasattr(inner, "elementType"):
                inner = inner.elementType
            walk(inner, name)

    walk(df.schema, "")
    return out


def cardinalities(counts: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """``name, n, expected, ok``: numbers of rows against what is expected of them."""
    out = None
    for name, (df, expected) in counts.items():
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.lit(expected).cast("long").alias("expected")).withColumn("ok", F.col("n") == F.col("expected"))
        out = row if out is None else out.unionByName(row)
    return out


def require_cardinalities(counts: dict[str, tuple[DataFrame, int]]) -> None:
    """Raise unless all numbers are as expected."""
    if bad := cardinalities(counts).where("not ok").collect():
        raise CheckFailed("; ".join(f"{r['name']}: {r.n} instead of {r.expected}" for r in bad))


def shared_families(roles: DataFrame, role: str, family: str) -> DataFrame:
    """``role_a, role_b, family``: pairs of roles that are of one family, where each should be of its own; roles are few."""
    r = roles.where(F.col(family).isNotNull()).select(F.col(role).alias("role_a"), F.lower(F.trim(family)).alias("family")).distinct()
    return r.join(r.select(F.col("role_a").alias("role_b"), "family"), "family").where("role_a < role_b").select("role_a", "role_b", "family")


def require_independent(roles: DataFrame, role: str, family: str) -> None:
    """Raise if two roles share a family, or a role has none."""
    if roles.where(F.col(family).isNull() | (F.trim(family) == "")).count():
        raise CheckFailed("a role without a family")
    if bad := shared_families(roles, role, family).limit(5).collect():
        raise CheckFailed("; ".join(f"{r.role_a} and {r.role_b} share {r.family}" for r in bad))


def reconcile_sides(expected: DataFrame, sides: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """``side, missing, extra, duplicates, ok`` of each of several sides against the expected keys, from one aggregate over all of them."""
    rows = expected.select(*keys, F.lit("").alias("_side"))
    for name, df in sides.items():
        rows = rows.unionByName(df.select(*keys, F.lit(name).alias("_side")))
    n = {name: F.count_if(F.col("_side") == name).alias(f"n{i}") for i, name in enumerate(["", *sides])}
    g = rows.groupBy(*keys).agg(*n.values())
    found = [
        F.struct(
            F.lit(name).alias("side"),
            F.count_if((F.col("n0") > 0) & (F.col(f"n{i}") == 0)).alias("missing"),
            F.count_if((F.col("n0") == 0) & (F.col(f"n{i}") > 0)).alias("extra"),
            F.count_if(F.col(f"n{i}") > 1).alias("duplicates"),
        )
        for i, name in enumerate(sides, 1)
    ]
    out = g.agg(F.array(*found).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    return out.withColumn("ok", F.expr("missing + extra + duplicates = 0"))


def require_all(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the wanted keys; raises if a key has none."""
    if missing := null_safe_join(wanted.select(*keys).distinct(), df, keys, "left_anti").limit(5).collect():
        raise CheckFailed(f"no row for {missing}")
    return null_safe_join(df, wanted, keys, "left_semi")


def reliable_rates(df: DataFrame, group: Sequence[str], reliable: Column, least: float) -> DataFrame:
    """``group, n, reliable_rate, ok``: whether enough of a group's rows are reliable."""
    g = df.groupBy(*group).agg(F.count("*").alias("n"), F.avg(F.coalesce(reliable, F.lit(False)).cast("double")).alias("reliable_rate"))
    return g.withColumn("ok", F.col("reliable_rate") >= least)


def first_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the ``n`` smallest keys: a limit that a sweep asks for. The keys are a top-n, and broadcast."""
    some = df.select(F.col(key).alias("_k")).distinct().orderBy("_k").limit(n)
    return df.join(F.broadcast(some), F.col(key) == F.col("_k"), "left_semi")
