"""Names to ids: normalisation, exact and fuzzy joins, and an id cascade with an audit column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks and name suffixes, in the order of their removal.
SUFFIXES = (".", "'", "-", " jr", " sr", " iii", " ii", " iv")


def normalize_name(name: Column) -> Column:
    """Lower case without the suffix tokens, white space collapsed."""
    out = F.trim(F.lower(name))
    for token in SUFFIXES:
        out = F.replace(out, F.lit(token), F.lit(""))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def letters_upper(value: Column) -> Column:
    return F.regexp_replace(F.upper(value), "[^A-Z]", "")


def similarity(a: Column, b: Column) -> Column:
    """100 * (1 - edit distance / longer length); 100 for two empty names."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 100.0).otherwise(100.0 * (1 - F.levenshtein(a, b) / longest))


def _edits(n: Column, share: float) -> Column:
    """The most edits that a name of this length may be away from one of its partners."""
    return F.floor(share * F.floor(n / (1 - share) + 1e-9) + 1e-9).cast("int")


def _piece(n: Column, pieces: Column, j: Column) -> tuple[Column, Column]:
    """Start, from 0, and length of piece j of a name of length n."""
    start = F.floor(j * n / pieces).cast("int")
    return start, F.floor((j + 1) * n / pieces).cast("int") - start


def _pieces(name: Column, share: float) -> Column:
    """A name cut into one piece more than it may have edits, so that one piece of it is whole in every partner."""
    n = F.length(name)
    count = _edits(n, share) + 1

    def cut(j: Column) -> Column:
        start, size = _piece(n, count, j)
        return F.struct(n.alias("n"), j.alias("j"), F.substring(name, start + 1, size).alias("piece"))

    return F.transform(F.sequence(F.lit(0), count - 1), cut)


def _probes(name: Column, share: float) -> Column:
    """The pieces, of all lengths of partners and at all places that edits allow, that stand in a name."""
    size = F.length(name)

    def of_length(n: Column) -> Column:
        k = _edits(n, share)

        def of_piece(j: Column) -> Column:
            start, width = _piece(n, k + 1, j)
            shifts = F.filter(F.sequence(-k, k), lambda s: (start + s >= 0) & (start + s + width <= size))
            return F.transform(shifts, lambda s: F.struct(n.alias("n"), j.alias("j"), F.substring(name, start + s + 1, width).alias("piece")))

        return F.flatten(F.transform(F.sequence(F.lit(0), k), of_piece))

    low, high = F.ceil(size * (1 - share) - 1e-9).cast("int"), F.floor(size / (1 - share) + 1e-9).cast("int")
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.greatest(low, F.lit(1)), F.greatest(high, F.lit(1))), of_length)))


def fuzzy_match(left: DataFrame, right: DataFrame, left_name: str, right_name: str, right_id: str, least: float = 90.0) -> DataFrame:
    """left with ``matched_id`` and ``match_score``: the equal name, else the most similar one of at least ``least``.

    Only distinct names are compared, and only where a piece of one stands in the other near its place: a name cut into
    one piece more than edits are allowed keeps a piece whole, so no match is lost. Ties go to the smaller id.
    """
    share = (100 - least) / 100
    names = left.select(F.lower(left_name).alias("l")).where("l is not null").distinct()
    known = right.groupBy(F.lower(right_name).alias("r")).agg(F.min(right_id).alias("id")).where("r is not null")
    exact = names.join(known, names.l == known.r).select("l", "id", F.lit(100.0).alias("score"))
    rest = names.join(exact, "l", "left_anti")
    probes = rest.select("l", F.explode(_probes(F.col("l"), share)).alias("p")).select("l", "p.*")
    pieces = known.select("r", "id", F.explode(_pieces(F.col("r"), share)).alias("p")).select("r", "id", "p.*")
    pairs = probes.join(pieces, ["n", "j", "piece"]).select("l", "r", "id").distinct()
    scored = pairs.select("l", "id", similarity(F.col("l"), F.col("r")).alias("score")).where(F.col("score") >= least)
    best = scored.groupBy("l").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("m")).select("l", "m.*")
    found = exact.unionByName(best).select("l", F.col("id").alias("matched_id"), F.col("score").alias("match_score"))
    return left.withColumn("l", F.lower(left_name)).join(found, "l", "left").drop("l")


def resolve_ids(rows: DataFrame, known: DataFrame, key: str, direct: str, name: str, kind: str) -> DataFrame:
    """rows with ``resolved``, ``method`` and ``candidates``.

    ``known(id, name, kind)``. In order: a direct id that is known, a name and kind that one id has, a name that one id
    has; otherwise the row is ambiguous or unmatched and its candidates are listed.
    """
    norm = known.select("id", normalize_name(F.col("name")).alias("n"), letters_upper(F.col("kind")).alias("k"))
    by_both = norm.groupBy("n", "k").agg(F.count_distinct("id").alias("c2"), F.min("id").alias("i2"))
    by_name = norm.groupBy("n").agg(F.count_distinct("id").alias("c1"), F.min("id").alias("i1"))
    out = rows.withColumn("n", normalize_name(F.col(name))).withColumn("k", letters_upper(F.col(kind)))
    # each name and kind that is asked for is resolved once; candidates are listed for the ambiguous names alone
    asked = out.select("n", "k").where("n is not null").distinct().join(by_both, ["n", "k"], "left").join(by_name, "n", "left")
    open_ = asked.where("c1 > 1 and not coalesce(c2 = 1, false)").select("n").distinct()
    listed = norm.join(open_, "n", "left_semi").groupBy("n").agg(F.sort_array(F.collect_set("id")).alias("all"))
    asked = asked.join(listed, "n", "left").withColumnRenamed("k", "__k")
    out = out.join(known.select(F.col("id").alias("__direct")).distinct(), F.col(direct) == F.col("__direct"), "left")
    out = out.join(asked.withColumnRenamed("n", "__n"), (F.col("n") == F.col("__n")) & F.col("k").eqNullSafe(F.col("__k")), "left")
    method = (
        F.when(F.col("__direct").isNotNull(), "direct").when(F.col("c2") == 1, "name_kind").when(F.col("c1") == 1, "name")
        .when(F.col("c1") > 1, "ambiguous").otherwise("unmatched")
    )
    resolved = F.coalesce("__direct", F.when(F.col("c2") == 1, F.col("i2")), F.when(F.col("c1") == 1, F.col("i1")))
    candidates = F.when(method == "ambiguous", F.col("all")).otherwise(F.array().cast("array<bigint>"))
    return out.select(*rows.columns, resolved.alias("resolved"), method.alias("method"), candidates.alias("candidates"))


def require_unique(df: DataFrame, keys: list[str], what: str) -> None:
    """Refuse a table in which a key occurs twice."""
    twice = df.groupBy(*keys).count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError(f"{what} is not unique on {', '.join(keys)}")


def merge_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], many_to_one: bool = False) -> DataFrame:
    """Inner join that refuses repeated keys, and left rows without a partner."""
    if not many_to_one:
        require_unique(left, keys, "the left table")
    require_unique(right, keys, "the right table")
    if not left.join(right, keys, "left_anti").isEmpty():
        raise ValueError("rows of the left table have no partner")
    return left.join(right, keys)


def align_inputs(inputs: dict[str, DataFrame], keys: list[str], least_share: float = 0.5) -> tuple[DataFrame, list[str]]:
    """Inner-join inputs one by one, leaving out an input that would lose more than this share of the rows."""
    names = list(inputs)
    joined, used = inputs[names[0]], names[:1]
    rows = joined.count()
    for name in names[1:]:
        trial = joined.join(inputs[name], keys)
        left = trial.count()
        if left >= least_share * rows:
            joined, rows = trial, left
            used.append(name)
    return joined, used


def co_movement(df: DataFrame, game: list[str], entity: str, value: str, least: int) -> DataFrame:
    """``(a, b, n, rho)``: correlation of two entities' values over the games of both, at least ``least`` of them."""
    x = df.select(*game, F.col(entity).alias("a"), F.col(value).alias("x"))
    y = df.select(*game, F.col(entity).alias("b"), F.col(value).alias("y"))
    pairs = x.join(y, game).where("a < b and x is not null and y is not null")
    found = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("rho"))
    return found.where(F.col("n") >= least)


__all__ = [
    "align_inputs", "co_movement", "fuzzy_match", "letters_upper", "merge_one_to_one", "normalize_name", "require_unique",
    "resolve_ids", "similarity",
]
