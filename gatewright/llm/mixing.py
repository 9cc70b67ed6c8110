"""Mixing sources to target weights by iterative proportional fitting, natively.

Documents are summed to cells (source, language, topic) of tokens.  A cell's inclusion
probability is min(1, a * b * c) with a factor for its source, its language and its
topic.  Margin after margin the factors are scaled until the expected tokens of every
source, language and topic are their target shares of the budget, so the bound on the
probability is inside the iteration.  Margins that need more tokens than there are
cannot be met at a large budget: the budget is lowered, by steps of LOWER, until every
margin is within TOLERANCE, which `margins` reports.

A document's place in its cell is a hash of its id, uniform in [0, 1).  The tokens of
each cell are summed by BUCKETS slices of that hash, and the slices are taken in order up
to the cut whose tokens come nearest to the expected ones; what a cell misses or has too
much is carried to the next cell of its topic and language.  So the realised shares
follow the targets closely too, where independent draws would not with long documents.

Targets are shares by value.  Values without a target form one group per dimension whose
share is what the targets leave; if a dimension has no targets at all, it is not raked.
There are at most (sources + 1) * (languages + 1) * (topics + 1) cells, a bound set by
the parameters: raking runs on one array of that many cells, at most BUCKETS rows of
sums come from each, and the cells' cuts are broadcast.  Values with a target but
without tokens cannot be raised; the others share their part in proportion.

Topics come from declared patterns (first match wins), or from a column named by
`topic_column`.

Defined results: null source or lang belongs to the group without a target; null and
empty texts have no tokens and are never kept; repeated rows share id and so are kept or
left together; a null id is an id; an empty table gives an empty result; columns of the
caller's stay, and one that has the name of a column made here is returned as `<name>_in`.
Only SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Sweeps over the three margins for one budget, the largest miss of a margin (as a share of the budget), and how the budget is lowered.
SWEEPS, TOLERANCE = 120, 0.001
LOWER, STEPS = 0.95, 90
BUCKETS = 1024
OTHER = "*"
SEED = 20
#: Production targets.
SOURCES = {f"src{i}": 0.0475 for i in range(20)}
LANGUAGES = {"en": 0.38, "fr": 0.19, "de": 0.19, "es": 0.19}
TOPICS = {"prose": 0.7, "table": 0.15, "licence": 0.05}
BUDGET = 0.5
#: Declared topics: name, pattern, and strings of which the text in lower case has one if the pattern matches (looked
#: for first, as that is cheap).  First match wins; anything else is prose.
TOPIC_RULES = [
    ("licence", r"(?i)\b(licen[sc]ed?|all rights reserved)\b", ("licen", "all rights reserved")),
    ("table", r" \| ", (" | ",)),
    ("shout", r"!! [^a-z]*!!", ("!! ",)),
    ("code", r"[{};]\s*\n", ("{", "}", ";")),
]
MADE = ("tokens", "topic_group", "probability", "mix_weight")

_TOKEN = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column, rules=TOPIC_RULES) -> Column:
    text, out = F.coalesce(text, F.lit("")), F.lit("prose")
    for name, pattern, hints in reversed(rules):
        look = F.lower(text) if any(c.isalpha() for h in hints for c in h) else text
        hinted = F.lit(False)
        for h in hints:
            hinted = hinted | F.contains(look, F.lit(h))
        out = F.when(hinted & text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _group(value: Column, targets: dict) -> Column:
    """Number of the value's group: its place among the targets, the last for all others."""
    value = value.cast("string")
    out = F.lit(len(targets))
    for i, name in enumerate(targets):
        out = F.when(value == name, F.lit(i)).otherwise(out)
    return out


def _tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_TOKEN)), F.lit(0)).cast("bigint")


def _let(name: str, value: str, body: str) -> str:
    """SQL of `body` with `name` bound to `value`, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _list(values) -> str:
    return f"array({', '.join(f'{float(v)!r}D' for v in values)})"


#: Field of a cell and of the state, by dimension.
_DIMS = (("s", "a"), ("l", "b"), ("t", "c"))


def _sum(dim: int, k: str) -> str:
    """Expected tokens of group k of a dimension under the state `st`."""
    rates = " * ".join(f"st.{f}[{k if i == dim else f'y.{d}'}]" for i, (d, f) in enumerate(_DIMS))
    return f"aggregate(by_{_DIMS[dim][0]}[{k}], 0D, (x, y) -> x + y.n * least(1D, {rates}))"


def _rake(dim: int, size: int) -> str:
    """The state with the factors of one dimension scaled to its goals."""
    d, f = _DIMS[dim]
    new = f"transform(sequence(0, {size - 1}), k -> {_let('m', _sum(dim, 'k'), f'IF(m > 0, least(1e15D, st.{f}[k] * z.beta * total * want_{d}[k] / m), 0D)')})"
    fields = ", ".join(f"'{g}', {new if g == f else 'st.' + g}" for _, g in _DIMS)
    return f"named_struct({fields})"


def raked(cells: DataFrame, sources: dict, languages: dict, topics: dict, budget: float) -> DataFrame:
    """(s, l, t, tokens, p, beta, miss) of all cells; `cells` is (s, l, t, tokens) by group numbers, bounded by the targets.

    beta is the share of all tokens that is sampled, miss the largest miss of a margin as a share of them.
    """
    dims = (sources, languages, topics)
    one = cells.where("tokens > 0").groupBy().agg(F.array_sort(F.collect_list(F.struct("s", "l", "t", F.col("tokens").cast("double").alias("n")))).alias("cells"))
    one = one.where("size(cells) > 0").withColumn("total", F.expr("aggregate(cells, 0D, (x, y) -> x + y.n)"))
    caps = []
    for (d, _), targets in zip(_DIMS, dims):
        size = len(targets) + 1
        one = one.withColumn(f"by_{d}", F.expr(f"transform(sequence(0, {size - 1}), k -> filter(cells, y -> y.{d} = k))"))
        one = one.withColumn(f"have_{d}", F.expr(f"transform(by_{d}, g -> aggregate(g, 0D, (x, y) -> x + y.n))"))
        goal = _list([*targets.values(), max(0.0, 1.0 - sum(targets.values()))])
        present = f"zip_with({goal}, have_{d}, (g, h) -> IF(h > 0, g, 0D))"
        share = _let("all", f"aggregate({present}, 0D, (x, y) -> x + y)", f"transform({present}, g -> IF(all > 0, g / all, 0D))")
        one = one.withColumn(f"want_{d}", F.expr(share))
        caps.append(f"array_min(zip_with(want_{d}, have_{d}, (g, h) -> IF(g > 0, h / (g * total), 1e9D)))")
    sweep = _rake(0, len(sources) + 1)
    sweep = _let("st", sweep, _rake(1, len(languages) + 1))
    sweep = _let("st", sweep, _rake(2, len(topics) + 1))
    start = ", ".join(f"'{f}', {_list([1.0] * (len(x) + 1))}" for (_, f), x in zip(_DIMS, dims))
    solved = f"aggregate(sequence(1, {SWEEPS}), named_struct({start}), (st, i) -> {sweep})"
    misses = ", ".join(f"array_max(transform(sequence(0, {len(x)}), k -> abs({_sum(i, 'k')} / (z.beta * total) - want_{_DIMS[i][0]}[k])))" for i, x in enumerate(dims))
    fields = ", ".join(f"'{f}', st.{f}" for _, f in _DIMS)
    attempt = _let("st", solved, f"named_struct('beta', z.beta, 'miss', greatest({misses}), {fields})")
    attempt = _let("z", f"named_struct('beta', z.beta * IF(j = 0, 1D, {LOWER}D))", attempt)
    zero = f"named_struct('beta', least({budget!r}D, {', '.join(caps)}), 'miss', 9D, {start})"
    one = one.withColumn("z", F.expr(f"aggregate(sequence(0, {STEPS}), {zero}, (z, j) -> IF(z.miss <= {TOLERANCE}D, z, {attempt}))"))
    found = one.select("z", F.explode("cells").alias("y"))
    return found.select("y.s", "y.l", "y.t", F.col("y.n").alias("tokens"), F.expr("least(1D, z.a[y.s] * z.b[y.l] * z.c[y.t])").alias("p"), F.col("z.beta").alias("beta"), F.col("z.miss").alias("miss"))


def _cuts(slices: DataFrame, plan: DataFrame) -> DataFrame:
    """(s, l, t, p, want, cut, got): slices of the hash below `cut` are kept, with `got` tokens where `want` are expected.

    `slices` is (s, l, t, u, tokens), at most BUCKETS rows for each cell.  Cells of a topic and language are dealt with in the
    order of their sources: the goal is that the tokens kept so far come nearest to those expected so far.
    """
    order = W.partitionBy("s", "l", "t").orderBy("u")
    run = slices.withColumn("upto", F.sum("tokens").over(order))
    lists = run.groupBy("s", "l", "t").agg(F.array_sort(F.collect_list(F.struct("u", "upto"))).alias("us"))
    lists = lists.join(plan, ["s", "l", "t"]).withColumn("want", F.col("p") * F.col("tokens"))
    rows = lists.groupBy("l", "t").agg(F.array_sort(F.collect_list(F.struct("s", "p", "want", "us"))).alias("cells"))
    # of all cuts (none, or after a slice) the one nearest to what is wanted and carried; all of it where p is 1, nothing where p is 0
    near = "aggregate(x.us, named_struct('cut', 0, 'got', 0D), (b, y) -> IF(abs(y.upto - x.want - z.rest) < abs(b.got - x.want - z.rest), named_struct('cut', y.u + 1, 'got', cast(y.upto as double)), b))"
    pick = f"CASE WHEN x.p >= 1 THEN named_struct('cut', {BUCKETS}, 'got', x.want) WHEN x.p <= 0 THEN named_struct('cut', 0, 'got', 0D) ELSE {near} END"
    step = _let("b", pick, "named_struct('rest', z.rest + x.want - b.got, 'out', concat(z.out, array(named_struct('s', x.s, 'p', x.p, 'want', x.want, 'cut', b.cut, 'got', b.got))))")
    walk = f"aggregate(cells, named_struct('rest', 0D, 'out', cast(array() as array<struct<s:int,p:double,want:double,cut:int,got:double>>)), (z, x) -> {step}, z -> z.out)"
    return rows.select("l", "t", F.explode(F.expr(walk)).alias("o")).select("o.s", "l", "t", "o.p", "o.want", "o.cut", "o.got")


def _place(seed: int) -> Column:
    """The slice of the id's hash."""
    return F.expr(f"cast(shiftrightunsigned(xxhash64({seed}, doc_id), 11) DIV {(1 << 53) // BUCKETS}L as int)")


def _planned(docs: DataFrame, sources: dict, languages: dict, topics: dict, budget: float, seed: int, topic: Column) -> tuple[DataFrame, DataFrame]:
    groups = docs.select(_group(F.col("source"), sources).alias("s"), _group(F.col("lang"), languages).alias("l"), _group(topic, topics).alias("t"), _place(seed).alias("u"), _tokens(F.col("text")).alias("tokens"))
    slices = groups.groupBy("s", "l", "t", "u").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    plan = raked(slices.groupBy("s", "l", "t").agg(F.sum("tokens").alias("tokens")), sources, languages, topics, budget)
    return plan, _cuts(slices, plan.select("s", "l", "t", "tokens", "p"))


def _targets(sources, languages, topics) -> tuple[dict, dict, dict]:
    return (SOURCES if sources is None else sources), (LANGUAGES if languages is None else languages), (TOPICS if topics is None else topics)


def mix(docs: DataFrame, sources: dict | None = None, languages: dict | None = None, topics: dict | None = None, budget: float = BUDGET, seed: int = SEED, topic_column: str | None = None) -> DataFrame:
    """Kept rows: all columns of `docs` plus tokens, topic_group, probability, and mix_weight (the cell's expected over its kept tokens)."""
    sources, languages, topics = _targets(sources, languages, topics)
    topic = topic_of(F.col("text")) if topic_column is None else F.col(f"`{topic_column}`")
    _, cuts = _planned(docs, sources, languages, topics, budget, seed, topic)
    cuts = cuts.where("cut > 0 and got > 0").select("s", "l", "t", "p", "want", "cut", "got")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    m = docs.select(row, _group(F.col("source"), sources).alias("s"), _group(F.col("lang"), languages).alias("l"), _group(topic, topics).alias("t"), _place(seed).alias("u"))
    kept = m.join(F.broadcast(cuts), ["s", "l", "t"]).where("u < cut").withColumn("tokens", _tokens(F.col("row.text"))).where("tokens > 0")
    names = F.array(*[F.lit(x) for x in [*topics, OTHER]])
    own = [F.col(f"row.`{c}`").alias(f"{c}_in" if c in MADE else c) for c in docs.columns]
    return kept.select(*own, "tokens", F.get(names, F.col("t")).alias("topic_group"), F.col("p").alias("probability"), (F.col("want") / F.col("got")).alias("mix_weight"))


def margins(docs: DataFrame, sources: dict | None = None, languages: dict | None = None, topics: dict | None = None, budget: float = BUDGET, seed: int = SEED, topic_column: str | None = None) -> DataFrame:
    """(dimension, value, target, planned, realised, budget): token shares by margin, of the plan and of the sample; a target
    without tokens has nulls for both.  `budget` is the share of all tokens that the plan takes."""
    sources, languages, topics = _targets(sources, languages, topics)
    topic = topic_of(F.col("text")) if topic_column is None else F.col(f"`{topic_column}`")
    plan, cuts = _planned(docs, sources, languages, topics, budget, seed, topic)
    out, spark = None, docs.sparkSession
    sums = cuts.agg(F.sum("want").alias("w"), F.sum("got").alias("g"))
    for (d, _), name, targets in zip(_DIMS, ("source", "language", "topic"), (sources, languages, topics)):
        left = max(0.0, 1.0 - sum(targets.values()))
        goals = spark.createDataFrame([(i, name, v, float(x)) for i, (v, x) in enumerate([*targets.items(), (OTHER, left)])], f"{d} int, dimension string, value string, target double")
        part = cuts.groupBy(d).agg(F.sum("want").alias("want"), F.sum("got").alias("got")).join(F.broadcast(sums))
        found = goals.join(part, d, "left").select("dimension", "value", "target", (F.col("want") / F.col("w")).alias("planned"), (F.col("got") / F.col("g")).alias("realised"))
        out = found if out is None else out.union(found)
    return out.join(F.broadcast(plan.agg(F.first("beta").alias("budget"))))
