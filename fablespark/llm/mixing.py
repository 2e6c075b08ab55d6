"""Mixing sources to target weights by hierarchical budgeting.

The tree has domains, languages within a domain and sources within a language;
its leaves are (domain, lang, source). A token budget is propagated from the
root: each node shares its budget among its children by weight, no child
getting more than its capacity (what its leaves hold, times the epochs that a
text may be seen). What a child can't take goes to its siblings by weight
before it concerns any ancestor: a node's own budget is never over its
capacity, so a shortage leaves a node only where all its children are full.
The level at which a sibling group fills up is found in closed form by sorting
on capacity per weight. Amounts are whole tokens, rounded down.

A leaf's tokens come from seeded epochs: whole epochs first, then the prefix of
the next epoch's order (by md5 of seed, epoch and doc_id; ties by doc_id) that
stays within the leaf's budget. The prefix is found in two steps, so that a hot
leaf is no single task: order values fall into slots, sums of slots give the
slot in which the budget ends, and just that slot's rows are sorted.

Cases: null and blank texts hold no tokens and are never taken; a null lang or
source counts as an empty name, a null doc_id as an empty one in the order;
rows of one leaf with equal doc_ids share one place in the order and are taken
together or not at all; an empty table gives an empty result; other columns
pass through; those named domain, epoch or n_tokens are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fablespark.llm.common import checkpointed, columns_but, free_prefix, quoted

LEAF = ("domain", "lang", "source")
#: Tables of leaves up to this many rows are broadcast; larger ones meet the documents salted.
BROADCAST_LEAVES = 50_000
SALTS = 16


@dataclass(frozen=True)
class MixPlan:
    """Weights are whole numbers by name; names that aren't listed have ``other``.

    ``share`` of all tokens is the budget. Domains come from the last digit of
    the source's name, for tables without a domain of their own.
    """

    share: float = 0.5
    max_epochs: int = 3
    seed: int = 17
    domains: dict[str, int] = field(default_factory=lambda: {"d0": 5, "d1": 3, "d2": 2})
    langs: dict[str, int] = field(default_factory=lambda: {"en": 4, "de": 2, "fr": 2, "es": 2})
    sources: dict[str, int] = field(default_factory=lambda: {"src0": 1})
    other: int = 2
    n_domains: int = 3


PLAN = MixPlan()


def token_count(text: Column) -> Column:
    """Runs of other than white space (x20, x09 to x0D)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def domain_of(source: Column, n_domains: int) -> Column:
    digits = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9])$", 1)
    return F.concat(F.lit("d"), F.when(digits == "", "0").otherwise((F.try_to_number(digits, F.lit("9")).cast("int") % n_domains).cast("string")))


def _weight(name: Column, weights: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for k, v in weights.items():
        out = F.when(name == k, v).otherwise(out)
    return out.cast("long")


def _shared_out(nodes: DataFrame, parent: list[str], name: str, plan_weights: dict[str, int], other: int) -> DataFrame:
    """``nodes`` (parent columns, name, capacity, given: the parent's budget) with budget.

    In order of capacity per weight, children fill up as long as their share of
    what the ones before left covers their capacity; all later ones share the rest.
    """
    w = nodes.withColumn("w", _weight(F.col(name), plan_weights, other)).filter("w > 0")
    group = Window.partitionBy(*parent)
    order = group.orderBy((F.col("capacity") / F.col("w")), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    x = w.withColumn("cap_before", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("w_left", F.sum("w").over(group) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    big = "decimal(38,0)"
    left = F.greatest(F.col("given") - F.col("cap_before"), F.lit(0)).cast(big)
    full = left * F.col("w").cast(big) >= F.col("capacity").cast(big) * F.col("w_left").cast(big)
    x = x.withColumn("full", full)
    # The first child that isn't full sets the level for itself and all after it.
    x = x.withColumn("level", F.min(F.when(~F.col("full"), F.struct(F.col("capacity") / F.col("w"), F.col(name), F.col("cap_before"), F.col("w_left")).alias("s"))).over(group))
    rest = F.greatest(F.col("given") - F.col("level.cap_before"), F.lit(0))
    part = F.least(F.call_function("div", rest.cast(big) * F.col("w").cast(big), F.col("level.w_left").cast(big)).cast("long"), F.col("capacity"))
    return x.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(part)).drop("cap_before", "w_left", "full", "level", "w", "given")


def leaf_budgets(leaves: DataFrame, plan: MixPlan = PLAN) -> DataFrame:
    """(domain, lang, source, supply, budget) from (domain, lang, source, supply)."""
    caps = leaves.withColumn("capacity", F.col("supply") * plan.max_epochs)
    langs = caps.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    domains = langs.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    total = leaves.agg(F.floor(F.sum("supply") * F.lit(plan.share)).cast("long").alias("given"))
    top = domains.crossJoin(F.broadcast(total)).withColumn("root", F.lit(0))  # one row with one number
    d = _shared_out(top, ["root"], "domain", plan.domains, plan.other).select("domain", F.col("budget").alias("given"))
    lang = _shared_out(langs.join(d, "domain"), ["domain"], "lang", plan.langs, plan.other).select("domain", "lang", F.col("budget").alias("given"))
    return _shared_out(caps.join(lang, ["domain", "lang"]), ["domain", "lang"], "source", plan.sources, plan.other).select(*LEAF, "supply", "budget")


def _at_leaves(rows: DataFrame, leaves: DataFrame, names: list[str], small: bool, salt: str = "salt") -> DataFrame:
    """``rows`` with the columns of their leaf. A hot leaf's rows stay where they are, or are spread over salts."""
    if small:
        return rows.join(F.broadcast(leaves), names)
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    return salted.join(leaves.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*names, salt]).drop(salt)


def _place(doc_id: Column, epoch: Column, seed: int) -> Column:
    key = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.md5(key.cast("binary"))


def mix(docs: DataFrame, plan: MixPlan = PLAN) -> DataFrame:
    """``docs`` with domain, n_tokens and epoch: one row for each time a text is taken."""
    names = columns_but(docs, "domain", "epoch", "n_tokens")
    leaf = [domain_of(F.col("source"), plan.n_domains).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")]
    slim = checkpointed(docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), *leaf, token_count(F.col("text")).alias("n_tokens")).filter("n_tokens > 0"))
    supply = slim.groupBy(*LEAF).agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("n"))
    counts, n_leaves = supply.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    small = n_leaves <= BROADCAST_LEAVES
    plans = leaf_budgets(supply.select(*LEAF, "supply"), plan)
    # Whole epochs, and the budget of the one after them.
    parts = checkpointed(plans.select(*LEAF, F.call_function("div", F.col("budget"), F.col("supply")).cast("int").alias("whole"), (F.col("budget") % F.col("supply")).alias("rest")))
    # About a thousand rows a slot in the largest leaf; slots are leading hexadecimal digits.
    digits = 1
    while digits < 8 and counts > 1000 * 16**digits:
        digits += 1
    placed = _at_leaves(slim, parts, list(LEAF), small).select(*LEAF, "rest", "n_tokens", "id", _place(F.col("id"), F.col("whole"), plan.seed).alias("place")).withColumn("slot", F.substring("place", 1, digits))
    slots = placed.groupBy(*LEAF, "slot", "rest").agg(F.sum("n_tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy(*LEAF).orderBy("slot"))
    edge = slots.withColumn("upto", upto).filter("upto > rest").groupBy(*LEAF).agg(F.min(F.struct("slot", "upto", "tokens")).alias("e"))
    edge = edge.select(*LEAF, F.col("e.slot").alias("slot"), (F.col("e.upto") - F.col("e.tokens")).alias("before"))
    edge = checkpointed(edge)
    inside = placed.join(F.broadcast(edge) if small else edge, [*LEAF, "slot"])
    # Rows with one place in the order count together.
    same = inside.groupBy(*LEAF, "slot", "before", "rest", "place", "id").agg(F.sum("n_tokens").alias("tokens"))
    run = F.sum("tokens").over(Window.partitionBy(*LEAF, "slot").orderBy("place", "id"))
    last = same.withColumn("run", F.col("before") + run).filter("run <= rest").groupBy(*LEAF).agg(F.max(F.struct("place", "id")).alias("last"))
    # Our columns beside those of the documents, under names that no document has.
    own = {c: free_prefix(docs) + c for c in [*LEAF, "n", "whole", "slot", "last", "salt"]}
    cuts = parts.join(edge, list(LEAF), "left").join(last, list(LEAF), "left").select(*[F.col(c).alias(own[c]) for c in [*LEAF, "whole", "slot", "last"]])
    full = docs.select("*", *[c.alias(own[n]) for c, n in zip(leaf, LEAF, strict=True)], token_count(F.col("text")).alias(own["n"])).filter(F.col(own["n"]) > 0)
    rows = _at_leaves(full, checkpointed(cuts), [own[c] for c in LEAF], small, own["salt"])
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    whole, slot = F.col(own["whole"]), F.col(own["slot"])
    place = _place(name, whole, plan.seed)
    # Rows before the edge slot are in; within it, those up to the last that fits.
    taken = F.when(slot.isNull(), True).otherwise((F.substring(place, 1, digits) < slot) | F.coalesce((F.substring(place, 1, digits) == slot) & (F.struct(place.alias("place"), name.alias("id")) <= F.col(own["last"])), F.lit(False)))
    epochs = F.filter(F.sequence(F.lit(0), whole), lambda e: (e < whole) | taken)
    return rows.select(*quoted(names), F.col(own["domain"]).alias("domain"), F.col(own["n"]).alias("n_tokens"), F.explode(epochs).alias("epoch"))


def _case(name: str, weights: dict[str, int], other: int) -> str:
    return "CASE " + name + "".join(f" WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {other} END"


def _level_sql(out: str, source: str, parent: str, name: str, weights: dict[str, int], other: int) -> str:
    return f"""
{out}_w AS (SELECT *, CAST({_case(name, weights, other)} AS HUGEINT) AS w FROM {source}),
{out}_b AS (SELECT *, coalesce(sum(capacity) OVER o, 0)::HUGEINT AS cap_before, (sum(w) OVER (PARTITION BY {parent}) - coalesce(sum(w) OVER o, 0))::HUGEINT AS w_left FROM {out}_w
  WINDOW o AS (PARTITION BY {parent} ORDER BY capacity::DOUBLE / w::DOUBLE, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{out}_f AS (SELECT *, greatest(given - cap_before, 0) * w >= capacity * w_left AS is_full FROM {out}_b),
{out}_l AS (SELECT *, first_value(CASE WHEN NOT is_full THEN cap_before END) OVER o AS l_cap, first_value(CASE WHEN NOT is_full THEN w_left END) OVER o AS l_w FROM {out}_f
  WINDOW o AS (PARTITION BY {parent} ORDER BY is_full, capacity::DOUBLE / w::DOUBLE, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
{out} AS (SELECT * EXCLUDE (given), CASE WHEN is_full THEN capacity ELSE least(greatest(given - l_cap, 0) * w // l_w, capacity) END AS budget FROM {out}_l)"""


def oracle_sql(plan: MixPlan = PLAN) -> str:
    tokens = r"len(list_filter(string_split_regex(text, '[ \t-\r]+'), lambda w: w <> ''))"
    return rf"""
WITH base AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         'd' || CASE WHEN regexp_extract(coalesce(source, ''), '([0-9])$', 1) = '' THEN '0' ELSE (CAST(regexp_extract(source, '([0-9])$', 1) AS INTEGER) % {plan.n_domains})::VARCHAR END AS domain,
         {tokens} AS n_tokens
  FROM documents WHERE {tokens} > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS supply, sum(n_tokens)::HUGEINT * {plan.max_epochs} AS capacity FROM base GROUP BY ALL),
dom0 AS (SELECT domain, 0 AS root, sum(capacity)::HUGEINT AS capacity, (SELECT floor(sum(supply) * {plan.share})::HUGEINT FROM leaves) AS given FROM leaves GROUP BY domain),
{_level_sql("dom", "dom0", "root", "domain", plan.domains, plan.other)},
lang0 AS (SELECT l.domain, l.lang, sum(l.capacity)::HUGEINT AS capacity, any_value(dom.budget) AS given FROM leaves l JOIN dom USING (domain) GROUP BY l.domain, l.lang),
{_level_sql("lng", "lang0", "domain", "lang", plan.langs, plan.other)},
src0 AS (SELECT l.*, lng.budget AS given FROM leaves l JOIN lng USING (domain, lang)),
{_level_sql("src", "src0", "domain, lang", "source", plan.sources, plan.other)},
epochs AS (SELECT b.*, s.budget, s.supply, CAST(e AS INTEGER) AS epoch, md5('{plan.seed}|' || e::VARCHAR || '|' || b.id) AS place
  FROM base b JOIN src s USING (domain, lang, source), range(0, {plan.max_epochs} + 1) AS r(e) WHERE e * s.supply < s.budget),
cut AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY place, id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM epochs)
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, epoch FROM cut WHERE epoch * supply + run <= budget
"""
