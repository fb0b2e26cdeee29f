"""Mixing to target weights by iterative proportional fitting, with DataFrame operations only.

Documents are counted into cells of (source, language, topic) with their tokens.  Raking multiplies each cell's weight
by the factor that brings the sum over one dimension to its target, for each dimension in turn, again and again; the
weights converge to the ones nearest the corpus that meet every marginal.  A document is then sampled with a
probability proportional to its cell's factor, so the sample's expected tokens have the calibrated shares, and the
draw is a hash of its id: the same on every run and every partitioning.

Targets are the user's, as a table of values and shares for a dimension, or the corpus' own shares, tempered.  Only cells
pass through the rounds: as many rows as combinations occur, however many documents there are.  Tokens are counted once;
ids, cells and counts are written as a narrow table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Length classes in tokens, used as the topic where the table has none (less than the bound: the name).
FORMS = ((100, "note"), (400, "short"), (1600, "article"))
LONGEST = "long"
WORDS = r"[^\x20\x09-\x0D]+"


def form(tokens: Column) -> Column:
    """Topic by the kind of text, here by its length."""
    out = F.when(tokens < FORMS[0][0], FORMS[0][1])
    for bound, name in FORMS[1:]:
        out = out.when(tokens < bound, name)
    return out.otherwise(LONGEST)


def uniform_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the MD5 of the key and a seed."""
    digest = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}"))), 1, 13)
    return F.conv(digest, 16, 10).cast("double") / float(1 << 52)


def one_row(df: DataFrame, other: DataFrame) -> DataFrame:
    """``df`` with the columns of ``other``, an aggregate of one row."""
    return df.crossJoin(F.broadcast(other))


def tempered_shares(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """``value, mass``: the tokens of each value of a dimension, raised to ``power``."""
    return cells.groupBy(F.col(dim).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("mass"))


def given_shares(cells: DataFrame, dim: str, targets: DataFrame) -> DataFrame:
    """``value, mass``: the given share of each value that the cells have tokens for, zero where none is given."""
    there = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").alias("tokens"))
    wanted = targets.select(F.col("value").alias("_wanted"), F.col("share").cast("double").alias("share"))
    mass = F.when(F.col("tokens") > 0, F.coalesce("share", F.lit(0.0))).otherwise(0.0)
    return there.join(wanted, F.col("value").eqNullSafe(F.col("_wanted")), "left").select("value", mass.alias("mass"))


def with_targets(cells: DataFrame, dims: Sequence[str], power: float, targets: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Cells with ``target_<dim>``, scaled to sum to one over the values that occur: given for the dimensions of ``targets``, tempered for others."""
    out = cells
    for d in dims:
        shares = given_shares(cells, d, targets[d]) if targets and d in targets else tempered_shares(cells, d, power)
        whole = one_row(shares, shares.agg(F.sum("mass").alias("_whole")))
        shares = whole.select(F.col("value").alias("_value"), F.coalesce(F.try_divide("mass", "_whole"), F.lit(0.0)).alias(f"target_{d}"))
        out = out.join(shares, F.col(d).eqNullSafe(F.col("_value"))).drop("_value")
    return out


def rake(cells: DataFrame, dims: Sequence[str], rounds: int) -> DataFrame:
    """Cells with ``share``: token weights, summing to one, raked to ``target_<dim>`` for each of ``dims``.

    ``cells`` has ``tokens`` (not negative).  A dimension's sums are aggregated, combined in each task first, and joined back, so cells
    of one value never meet in a task; Spark broadcasts the sums where they are few.  Each round is written.
    """
    total = cells.agg(F.sum(F.col("tokens").cast("double")).alias("_total"))
    out = one_row(cells, total).withColumn("share", F.col("tokens") / F.when(F.col("_total") > 0, F.col("_total")))
    for _ in range(rounds):
        for d in dims:
            sums = out.groupBy(F.col(d).alias("_value")).agg(F.sum("share").alias("_found"))
            out = out.join(sums, F.col(d).eqNullSafe(F.col("_value")))
            out = out.withColumn("share", F.coalesce(F.col("share") * F.col(f"target_{d}") / F.when(F.col("_found") > 0, F.col("_found")), F.lit(0.0))).drop("_value", "_found")
        out = written(out)
    return out


DIMENSIONS = ("source", "lang", "topic")


def with_cells(docs: DataFrame, text_col: str, source_col: str, lang_col: str, topic: Column | None) -> DataFrame:
    """``docs`` with ``_tokens`` and the cell it is in: ``_source, _lang, _topic``."""
    tokens = F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)).cast("long")
    out = docs.withColumns({"_tokens": tokens, "_source": F.col(source_col), "_lang": F.col(lang_col)})
    return out.withColumn("_topic", form(F.col("_tokens")) if topic is None else topic)


def cell_weights(celled: DataFrame, power: float, rounds: int, targets: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """``source, lang, topic, weight, probability`` for each cell that occurs."""
    cells = written(celled.groupBy(*(F.col(f"_{d}").alias(d) for d in DIMENSIONS)).agg(F.sum("_tokens").alias("tokens")))
    raked = rake(written(with_targets(cells, DIMENSIONS, power, targets)), DIMENSIONS, rounds)
    weight = F.when(F.col("tokens") > 0, F.col("share") * F.col("_total") / F.col("tokens")).otherwise(0.0)
    weighed = raked.select(*DIMENSIONS, weight.alias("weight"))
    greatest = weighed.agg(F.max(F.when(F.col("weight") > 0, F.col("weight"))).alias("_greatest"))
    return one_row(weighed, greatest).select(*DIMENSIONS, "weight", F.coalesce(F.col("weight") / F.col("_greatest"), F.lit(0.0)).alias("probability"))


def draw(id_col: str, seed: int) -> Column:
    """The document's number in [0, 1); it is kept if that is below its probability."""
    return uniform_hash(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), seed)


def _join(celled: DataFrame, weights: DataFrame) -> DataFrame:
    named = weights.select(*(F.col(d).alias(f"_to_{d}") for d in DIMENSIONS), F.col("weight").alias("_weight"), F.col("probability").alias("_probability"))
    return celled.join(named, [F.col(f"_{d}").eqNullSafe(F.col(f"_to_{d}")) for d in DIMENSIONS])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
        topic: Column | None = None, power: float = 0.9, rounds: int = 10, seed: int = 42, targets: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """``doc_id, source, lang, topic, tokens, weight, probability, kept`` for every row.

    ``targets`` has a table ``value, share`` for any of ``source``, ``lang`` and ``topic``; its values are different.  A
    value that the table does not name gets share 0, so its documents go; one that no document with tokens has cannot be met,
    and the other shares of its dimension are scaled up to sum to one.  Where two dimensions contradict each other the last
    one raked, topic, is met.  For a dimension without a table the targets are the corpus' token shares raised to ``power``
    and scaled to sum to one.

    ``weight`` is the calibrated share over the corpus share of the row's cell, ``probability`` the weight over the largest
    one, so that a cell most wanted is kept whole and as much as possible of the rest.  Without ``topic`` the kind of text
    by its length stands for it.  NULL and empty texts have no tokens and are drawn with their cell; a cell without tokens has
    weight 0 and is dropped.
    NULL sources and languages are values like any other.  Repeated rows of an id share one draw, and so do rows without an
    id.  An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"),
                       *([] if topic is None else [topic.alias("topic")]))
    celled = written(with_cells(rows, "text", "source", "lang", None if topic is None else F.col("topic")).select("doc_id", "_tokens", *(f"_{d}" for d in DIMENSIONS)))
    return _join(celled, cell_weights(celled, power, rounds, targets)).select(
        "doc_id", *(F.col(f"_{d}").alias(d) for d in DIMENSIONS), F.col("_tokens").alias("tokens"), F.col("_weight").alias("weight"),
        F.col("_probability").alias("probability"), (draw("doc_id", seed) < F.col("_probability")).alias("kept"))


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
            power: float = 0.9, rounds: int = 10, seed: int = 42, targets: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The rows of ``docs`` that :func:`mix` keeps, with all their columns.

    Texts are read twice, to count the cells and to sample; only the small table of cells is joined to them.
    """
    celled = with_cells(docs, text_col, source_col, lang_col, None)
    kept = _join(celled, cell_weights(celled, power, rounds, targets)).filter(draw(id_col, seed) < F.col("_probability"))
    return kept.select(*docs.columns)


def mix_sql(documents: str = "documents", power: float = 0.9, rounds: int = 10, seed: int = 42, targets: Mapping[str, str] | None = None) -> str:
    """The same as DuckDB SQL; ``targets`` names a table for a dimension."""

    def target(d: str) -> str:
        mass = f"select {d}, pow(sum(tokens)::double, {power}) as m from c group by {d}"
        if targets and d in targets:
            mass = (f"select {d}, case when n > 0 then coalesce(share, 0) else 0 end as m from (select {d}, sum(tokens) as n from c group by {d})"
                    f" left join {targets[d]} on {d} is not distinct from value")
        return f"t_{d} as (select {d}, coalesce(m / nullif(sum(m) over (), 0), 0) as target from ({mass}))"

    cases = " ".join(f"when tokens < {bound} then '{name}'" for bound, name in FORMS)
    words = r"[^\x20\x09-\x0D]+"
    ctes = [
        f"r0 as (select doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '{words}')) as tokens from {documents})",
        f"r as (select *, case {cases} else '{LONGEST}' end as topic from r0)",
        "c as (select source, lang, topic, sum(tokens)::bigint as tokens from r group by all)",
        *map(target, DIMENSIONS),
        "s0 as (select c.*, a.target as ts, b.target as tl, e.target as tt, tokens / nullif(sum(tokens::double) over (), 0) as share from c"
        " join t_source a on c.source is not distinct from a.source join t_lang b on c.lang is not distinct from b.lang"
        " join t_topic e on c.topic is not distinct from e.topic)",
    ]
    n = 0
    for _ in range(rounds):
        for d, t in (("source", "ts"), ("lang", "tl"), ("topic", "tt")):
            ctes.append(f"s{n + 1} as materialized (select * replace (coalesce(share * {t} / nullif(sum(share) over (partition by {d}), 0), 0) as share) from s{n})")
            n += 1
    ctes.append(f"w as (select source, lang, topic, case when tokens > 0 then share * sum(tokens::double) over () / tokens else 0 end as weight from s{n})")
    ctes.append("p as (select *, coalesce(weight / nullif(max(weight) over (), 0), 0) as probability from w)")
    draw = f"('0x' || md5(coalesce(doc_id::varchar, 'null') || '|{seed}')[1:13])::bigint::double / 4503599627370496"
    return (f"with {', '.join(ctes)} select doc_id, r.source, r.lang, r.topic, tokens::bigint as tokens, round(weight, 6) as weight,"
            f" round(probability, 6) as probability, {draw} < probability as kept from r join p on r.source is not distinct from p.source"
            " and r.lang is not distinct from p.lang and r.topic = p.topic")
