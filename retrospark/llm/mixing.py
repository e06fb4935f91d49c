"""Mixing sources to target weights: iterative proportional fitting, then Poisson sampling.

Documents are counted into cells (source, language, topic) with their token weight.  The cell
weights are raked: the factors of the sources, then of the languages, then of the topics are set
so that the weighted marginal meets its target, never above the tokens that the cell has, and so
on for a fixed number of rounds.  A document is then kept with the probability kept weight / tokens of
its cell, decided by a hash of its id, so that the choice is the same on every run and on any
partitioning.

One pass over the documents makes the cell table (map-side combined; one row per cell).  The
rounds work on that table alone, as DataFrame windows whose lineage is cut by ``materialize``.
Only DataFrame operations are used.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrospark.llm.common import materialize

DIMS = ("source", "lang", "topic")
OTHER = "other"


def n_tokens(text: Column) -> Column:
    """Words of a text, parted by space, tab and line breaks."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", -1), lambda w: w != "")).cast("bigint")


def topic_of(tokens: Column) -> Column:
    """The registered query's topic: the document's form by length (texts of the tables have no topic column)."""
    return F.when(tokens < 100, "note").when(tokens < 400, "article").when(tokens < 1500, "report").otherwise("book")


def category(col: Column, targets: Mapping[str, float]) -> Column:
    """A value that the targets name, else ``other`` (null, too)."""
    return F.when(col.isin(*targets), col).otherwise(F.lit(OTHER))


def _share(col: Column, targets: Mapping[str, float]) -> Column:
    """A category's share, looked up in one map (null or unlisted: that of ``other``)."""
    known = F.create_map(*[F.lit(x) for k in sorted(targets) for x in (k, float(targets[k]))]) if targets else None
    other = F.lit(float(targets.get(OTHER, 0.0)))
    return other if known is None else F.coalesce(F.try_element_at(known, F.coalesce(col, F.lit(OTHER))), other)


def fit_cells(cells: DataFrame, targets: Mapping[str, Mapping[str, float]], rounds: int, keep: float | None = None, cut_every: int = 5, least: float = 0.0) -> DataFrame:
    """Rake the cells (source, lang, topic, tokens) to the targets: adds ``weight`` (tokens to keep) and ``keep``.

    ``targets`` gives a share per category of each dimension; categories without tokens are left
    out and the others' shares are scaled to sum to 1.  A share of 0 empties its cells.  Without
    ``keep`` the weights sum to all tokens and a cell's may exceed what it has.  With it no cell
    is asked for more than it has: ``keep`` is lowered to what the scarcest category allows, but not
    below ``least`` (a scarcer category then keeps all it has and stays below its target), and
    each scaling step is cut at the cell's tokens; later steps hand what was cut to the other cells.
    """
    total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 0.0
    out, goals, bounded = cells, [], keep is not None
    keep = keep if bounded else 1.0
    for dim in DIMS:
        held = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).where("t > 0").select("t", _share(F.col(dim), targets[dim]).alias("s"))
        facts = held.agg(F.sum("s").alias("shares"), F.min(F.when(F.col("s") > 0, F.col("t") / F.col("s"))).alias("scarce")).first()  # one row
        goals.append((dim, total / facts["shares"] if facts["shares"] else 0.0))
        if bounded and facts["shares"]:
            keep = min(keep, facts["scarce"] * facts["shares"] / total)
    keep = max(keep, least)
    for dim, scale in goals:
        out = out.withColumn(f"{dim}_goal", _share(F.col(dim), targets[dim]) * F.lit(scale * keep))
    out = out.withColumn("weight", F.col("tokens") * F.lit(keep))
    for i in range(rounds):
        for dim in DIMS:
            margin = F.sum("weight").over(Window.partitionBy(dim))
            scaled = F.when(margin > 0, F.col("weight") * F.col(f"{dim}_goal") / margin).otherwise(F.lit(0.0))
            out = out.withColumn("weight", F.least(F.col("tokens").cast("double"), scaled) if bounded else scaled)
        if (i + 1) % cut_every == 0:
            out = materialize(out)
    return out.drop(*[f"{d}_goal" for d in DIMS]).withColumn("keep", F.lit(float(keep)))


def uniform(doc_id: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the id: the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]],
    keep: float = 1.0,
    rounds: int = 20,
    seed: int = 0,
    topic: Column | None = None,
    tokens: Column | None = None,
    least: float = 0.0,
) -> DataFrame:
    """Every input row with tokens, topic, factor (raked / own tokens), probability and ``kept``.

    ``keep`` is the share of all tokens that is expected to stay; it is lowered to the share that the
    scarcest category allows, though not below ``least`` (column ``keep_share``).  :func:`margins` compares the shares reached
    with the targets.  Input columns named tokens, topic, factor, probability, keep_share or kept
    are replaced; any other name may occur.

    Defined cases: null text has 0 tokens; null or unlisted source, lang or topic is the category
    ``other`` (share 0 unless the targets name it); a cell without tokens has factor 0; rows that
    repeat a doc_id are kept or dropped together within a cell; null ids share one draw; an empty
    table gives no rows.
    """
    own = "_"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    name = lambda c: f"{own}{c}"
    tok = n_tokens(F.col("text")) if tokens is None else tokens
    top = topic_of(F.col(name("tokens"))) if topic is None else topic
    rows = docs.withColumn(name("tokens"), tok).withColumn(name("topic"), category(top, targets["topic"]))
    rows = rows.withColumn(name("source"), category(F.col("source"), targets["source"])).withColumn(name("lang"), category(F.col("lang"), targets["lang"]))
    cells = rows.groupBy(*[F.col(name(d)).alias(d) for d in DIMS]).agg(F.sum(name("tokens")).alias("tokens"))
    fitted = materialize(fit_cells(materialize(cells), targets, rounds, float(keep), least=float(least)))
    chance = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(0.0))
    prob = fitted.select(
        *[F.col(d).alias(name(d)) for d in DIMS],
        (chance / F.col("keep")).alias(name("factor")), chance.alias(name("p")), F.col("keep").alias(name("keep")),
    )
    out = rows.join(prob, [name(d) for d in DIMS], "left")
    made = {"tokens", "topic", "factor", "probability", "keep_share", "kept"}
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in made],
        F.col(name("tokens")).alias("tokens"),
        F.col(name("topic")).alias("topic"),
        F.round(name("factor"), 9).alias("factor"),
        F.round(name("p"), 9).alias("probability"),
        F.round(name("keep"), 9).alias("keep_share"),
        (uniform(F.col("doc_id"), seed) < F.round(name("p"), 9)).alias("kept"),
    )


def margins(mixed: DataFrame, targets: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """dimension, category, target, expected, realised (shares of the kept tokens) of what :func:`mix` returned.

    ``target`` is scaled to the categories that have tokens; a difference between ``expected`` and
    ``target`` is what the documents at hand cannot give.
    """
    chosen = F.when(F.col("kept"), F.col("tokens")).otherwise(0)
    out = None
    for dim in DIMS:
        by = mixed.groupBy(category(F.col(dim), targets[dim]).alias("category")).agg(
            F.sum("tokens").alias("held"), F.sum(F.col("tokens") * F.col("probability")).alias("expected"), F.sum(chosen).alias("realised")
        )
        whole = Window.partitionBy("dimension")  # a row a category
        part = by.where("held > 0").select(F.lit(dim).alias("dimension"), "category", _share(F.col("category"), targets[dim]).alias("target"), "expected", "realised")
        part = part.select("dimension", "category", *[(F.col(c) / F.sum(c).over(whole)).alias(c) for c in ("target", "expected", "realised")])
        out = part if out is None else out.unionByName(part)
    return out
