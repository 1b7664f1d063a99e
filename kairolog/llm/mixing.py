"""Mixing sources to target weights: a token budget is handed down a domain-language-source tree.

At each node the budget is shared among the children by weight; a child takes no more than its subtree can give
(max_epochs times its tokens), and what it leaves goes to its siblings. Only what all siblings together can't take is
left to the parent's siblings, as the parent's own capacity is the sum of theirs. Each leaf then takes whole epochs and
of the next one a token-prefix, in that epoch's seeded order. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairolog.llm.shared import aside, free_name, own, saved, small, workspace

LEVELS = ("domain", "lang", "source")
#: Columns that mix_sources() adds.
MADE = ("domain", "n_tokens", "epoch_tokens", "target", "copies")
#: Rows of a leaf that share one slice of its seeded order, about.
SLICE_ROWS = 1024


@dataclass(frozen=True)
class Mix:
    """Whole-number weights by domain, language and source (other names: `rest`); domains: of a source (others:
    `other`). The budget is budget[0] / budget[1] of the table's tokens."""

    domains: Mapping[str, str] = field(default_factory=dict)
    weights: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    rest: int = 5
    budget: tuple[int, int] = (3, 4)
    max_epochs: int = 3
    seed: int = 17


PRODUCTION = Mix(
    domains={**{f"src{i}": "web" for i in range(5)}, **{f"src{i}": "news" for i in range(5, 10)}, **{f"src{i}": "books" for i in range(10, 15)}},
    weights={"domain": {"web": 40, "news": 25, "books": 20, "other": 15}, "lang": {"en": 50, "fr": 20, "de": 20, "es": 10}, "source": {}},
)


def words(text: Column) -> Column:
    """The default token count: runs of other characters than space, tab, line feed and carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def _looked_up(table: Mapping, key: Column, other) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(other)) if pairs else F.lit(other)


def _shared_out(nodes: DataFrame, parent: tuple[str, ...], child: str) -> DataFrame:
    """nodes: parent and child names, budget (the parent's), weight, room. Adds given. Children are filled in the
    order of room per weight: one is full if its part of what is left holds all its room; those after the full ones
    share the rest by weight, rounded down."""
    order = Window.partitionBy(*parent).orderBy(F.col("room") / F.col("weight"), child)
    before = F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    n = nodes.withColumns({"left": F.col("budget") - before, "above": weight})
    n = n.withColumn("full", F.col("room") * F.col("above") <= F.col("weight") * F.col("left"))
    n = n.withColumn("first", F.min(F.when(~F.col("full"), F.struct(F.col("room") / F.col("weight"), F.col(child), "left", "above"))).over(Window.partitionBy(*parent)))
    return n.withColumn("given", F.when(F.col("full"), F.col("room")).otherwise(F.expr("weight * first.left div first.above"))).drop("left", "above", "full", "first")


def leaf_targets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves: domain, lang, source, tokens, rows. Adds target: the tokens that the leaf gives, epochs counted."""
    total = leaves.agg(F.expr(f"sum(tokens) * {mix.budget[0]} div {mix.budget[1]}").cast("long").alias("budget"))
    room = F.col("tokens") * mix.max_epochs
    given = None
    for depth, child in enumerate(LEVELS):
        parent = LEVELS[:depth]
        nodes = leaves.groupBy(*LEVELS[: depth + 1]).agg(F.sum(room).alias("room"), F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows"))
        above = total if given is None else given.select(*parent, F.col("given").alias("budget"))
        nodes = nodes.join(F.broadcast(above)) if given is None else nodes.join(above, list(parent))  # total is one row
        nodes = nodes.withColumn("weight", _looked_up(mix.weights.get(child, {}), F.col(child), mix.rest).cast("long"))
        given = _shared_out(nodes, parent, child)
    return given.select(*LEVELS, "tokens", "rows", F.col("given").alias("target"))


def mix_sources(docs: DataFrame, mix: Mix = PRODUCTION, key: str = "doc_id", text: str = "text", tokens=words) -> DataFrame:
    """docs with domain, n_tokens, epoch_tokens (of its leaf), target (of its leaf) and copies: how often the row is
    in the mixture, 0 too. (Columns of these names are replaced.) A null lang or source counts as `none`; a null text
    has no tokens. In a leaf's last epoch a row is taken if the tokens before it don't reach the leaf's rest; its order
    is that of a hash of seed, epoch and key, then key, then the text. Weights must be positive. Rows that are equal in all of these may stand
    for each other. An empty table gives an empty one."""
    out = [x for c, x in zip(docs.columns, own(docs), strict=True) if c.lower() not in MADE]
    leaf, spot, piece, edge, base, whole, rest, bits, before = free_name(docs, "_leaf", "_spot", "_slice", "_edge", "_base", "_whole", "_rest", "_bits", "_before")
    source = F.coalesce(F.col("source"), F.lit("none"))
    names = F.struct(_looked_up(mix.domains, source, "other").alias("domain"), F.coalesce(F.col("lang"), F.lit("none")).alias("lang"), source.alias("source"))
    d = docs.select(*out, names.alias(leaf), tokens(F.col(text)).alias("n_tokens"))
    folder = workspace(docs.sparkSession, "mixing")
    leaves = saved(d.groupBy(leaf).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).select(f"{leaf}.*", "tokens", "rows"), f"{folder}/leaves")
    plan = leaf_targets(leaves, mix).select(
        F.struct(*LEVELS).alias(leaf), F.col("tokens").alias("epoch_tokens"), "target", F.expr("coalesce(target div nullif(tokens, 0), 0)").alias(whole),
        F.expr("coalesce(target % nullif(tokens, 0), 0)").alias(rest), F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / SLICE_ROWS))).cast("int").alias(bits),
    )
    plan = saved(plan, f"{folder}/plan")
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col(whole), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 15)
    placed = lambda p: d.join(small(p), leaf).withColumn(spot, F.conv(digits, 16, 10).cast("long")).withColumn(piece, F.expr(f"shiftright(`{spot}`, 60 - `{bits}`)"))
    sums = placed(plan).filter(F.col(rest) > 0).groupBy(leaf, rest, piece).agg(F.sum("n_tokens").alias("sum"))
    run = F.sum("sum").over(Window.partitionBy(leaf).orderBy(piece))
    sums = sums.withColumn("run", run).filter((F.col("run") >= F.col(rest)) & (F.col("run") - F.col("sum") < F.col(rest)))
    edges = saved(plan.join(sums.groupBy(leaf).agg(F.min(F.struct(F.col(piece).alias("at"), (F.col("run") - F.col("sum")).alias("before"))).alias("e")), leaf, "left").select(*plan.columns, F.coalesce("e.at", F.lit(-1)).alias(edge), F.coalesce("e.before", F.lit(0)).alias(base)), f"{folder}/edges")
    all_rows = placed(edges)
    inside = all_rows.filter(F.col(piece) != F.col(edge)).withColumn("copies", F.col(whole) + (F.col(piece) < F.col(edge)).cast("long"))
    tie = Window.partitionBy(leaf, piece).orderBy(spot, key, text).rowsBetween(Window.unboundedPreceding, -1)
    at_edge = all_rows.filter(F.col(piece) == F.col(edge)).withColumn(before, F.col(base) + F.coalesce(F.sum("n_tokens").over(tie), F.lit(0)))
    at_edge = at_edge.withColumn("copies", F.col(whole) + (F.col(before) < F.col(rest)).cast("long")).drop(before)
    return inside.unionByName(at_edge).select(*out, F.col(leaf)["domain"].alias("domain"), "n_tokens", "epoch_tokens", "target", "copies")


def sampled(docs: DataFrame, mix: Mix = PRODUCTION, key: str = "doc_id", text: str = "text", tokens=words) -> DataFrame:
    """The mixture itself: the rows of docs, all columns whatever their names, as often as mix_sources() takes them. Nulls,
    repeated rows and an empty table are treated as there."""
    moved, back = aside(docs, *MADE)
    mixed = mix_sources(moved, mix, key, text, tokens).filter(F.col("copies") > 0)
    (epoch,) = free_name(mixed, "_epoch")
    kept = [x for c, x in zip(mixed.columns, own(mixed), strict=True) if c in moved.columns]
    return mixed.select(*kept, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(epoch)).select(*back)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch_tokens", "target", "copies")


def sql(documents: str = "documents", mix: Mix = PRODUCTION) -> str:
    """The same in DuckDB's SQL over a table or subquery."""
    case = lambda table, column, other: f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items()) + f" ELSE {other!r} END" if table else repr(other)

    def level(depth: int) -> str:
        child, parent = LEVELS[depth], ", ".join(LEVELS[:depth])
        part, names = f"PARTITION BY {parent}" if parent else "", ", ".join(LEVELS[: depth + 1])
        above = f"JOIN given{depth - 1} g USING ({parent})" if parent else "CROSS JOIN budget g"
        return f"""
  room{depth} AS (SELECT {names}, sum(tokens * {mix.max_epochs})::BIGINT AS room, any_value(budget) AS budget, ({case(mix.weights.get(child, {}), child, mix.rest)})::BIGINT AS weight
    FROM leaves l {above} GROUP BY {names}),
  fill{depth} AS (SELECT *, budget - coalesce(sum(room) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lft,
    (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS above FROM room{depth} WINDOW w AS ({part} ORDER BY room / weight, {child})),
  given{depth} AS (SELECT {names}, CASE WHEN room * above <= weight * lft THEN room ELSE
    weight * min_by(lft, (room / weight, {child})) FILTER (room * above > weight * lft) OVER ({part}) // min_by(above, (room / weight, {child})) FILTER (room * above > weight * lft) OVER ({part}) END AS budget
    FROM fill{depth})"""

    return f"""
WITH base AS (SELECT *, {case(mix.domains, "coalesce(source, 'none')", "other")} AS domain, coalesce(lang, 'none') AS lang0, coalesce(source, 'none') AS source0,
    len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+'))::BIGINT AS n_tokens FROM {documents}),
  leaves AS (SELECT domain, lang0 AS lang, source0 AS source, sum(n_tokens)::BIGINT AS tokens FROM base GROUP BY ALL),
  budget AS (SELECT (sum(tokens) * {mix.budget[0]} // {mix.budget[1]})::BIGINT AS budget FROM leaves),{",".join(map(level, range(3)))},
  plan AS (SELECT domain, lang, source, tokens, g.budget AS target, coalesce(g.budget // nullif(tokens, 0), 0) AS whole, coalesce(g.budget % nullif(tokens, 0), 0) AS rest
    FROM leaves JOIN given2 g USING (domain, lang, source)),
  placed AS (SELECT b.*, p.tokens AS epoch_tokens, p.target, p.whole, p.rest, md5(concat_ws(':', '{mix.seed}', p.whole, coalesce(doc_id::VARCHAR, '')))[1:15] AS spot
    FROM base b JOIN plan p ON p.domain = b.domain AND p.lang = b.lang0 AND p.source = b.source0),
  run AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang0, source0 ORDER BY spot, doc_id, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, epoch_tokens, target, (whole + CASE WHEN before < rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM run"""
