"""Rules over events.

Two plans with equal results, both one narrow pass in which an event stays a row, so keys may repeat or be null and streams
are evaluated like tables.  *Projection*: one boolean column a rule, for small rulesets.  *Search*: for thousands of rules,
whose expression would cost more to compile than to run: literals of all rules are looked for at once in the fields that
an event has, other predicates are columns, and rules are counted over their clauses.
"""

from __future__ import annotations

import copy
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import literals, predicates, transforms
from ..functions.registry import Registry
from ..plans import condition
from ..plans.compiler import usable
from ..plans.ir import Dropped, EngineConfig, Primitive, Rule, Ruleset

#: Clauses of a rule in the search plan at most; rules with more stay projections.
MOST_CLAUSES = 512
#: Predicates that become one array; smaller arrays keep generated methods small.
TOGETHER = 100


def _not(x: Column) -> Column:
    return ~x


class _Extracted:
    """Fields that were read into columns."""

    def __init__(self, names: dict[str, str]):
        self.names = names

    def field(self, name: str) -> Column:
        return F.col(self.names[name])

    def all_values(self) -> Column:
        return F.col("av")


def _primitives(rule: Rule, tree: tuple) -> set[int]:
    """All that a rule's condition looks at."""
    seen: set[int] = set()
    condition.fold(tree, rule, lambda p: seen.add(p), lambda x: None, lambda x: None, lambda x: None, lambda n, x: None)
    return seen


class Engine:
    """An executable ruleset over events read through ``fields`` (JsonEvents or TypedEvents)."""

    def __init__(self, ruleset: Ruleset, fields, config: EngineConfig | None = None, registry: Registry | None = None):
        self.ruleset, self.fields, self.config = ruleset, fields, config or EngineConfig()
        self.registry = registry or Registry()
        for phase in ("discovery", "pre"):
            for p in ruleset.primitives:
                self.registry.run_hooks(phase, p)
        self.rules, self.dropped = usable(ruleset)
        for p in ruleset.primitives:
            self.registry.run_hooks("post", p)

    # accessors
    def contains_rule(self, rule_id: int) -> bool:
        return any(r.rule_id == rule_id for r, _ in self.rules)

    def rule_count(self) -> int:
        return len(self.rules)

    def statistics(self) -> dict:
        """Size of the compiled rules."""
        shapes = [condition.shape(t, r) for r, t in self.rules]
        used: dict[int, int] = {}
        for rule, _ in self.rules:
            own = {p for ps in rule.selections.values() for p in ps} | {p for gs in rule.disjunctions.values() for g in gs for p in g}
            for p in own:
                used[p] = used.get(p, 0) + 1
        return {"primitives": len(self.ruleset.primitives), "rules": len(self.rules), "dropped": len(self.dropped), "operations": sum(s["operations"] for s in shapes), "max_depth": max((s["depth"] for s in shapes), default=0), "shared_primitives": sum(n > 1 for n in used.values()), "max_fanout": max(used.values(), default=0)}

    # columns
    def value(self, p: Primitive) -> Column:
        if self.registry.extractor is not None and not isinstance(self.fields, _Extracted):
            return self.registry.extractor(p.field)
        return self.fields.field(p.field)

    def _test(self, value: Column, p: Primitive) -> Column:
        if self.config.mode != "spec":
            return self.registry.matcher(p.match_type)(value, list(p.values), p.modifiers)
        values, extra = list(p.values), []
        decoders = [m for m in p.modifiers if m in self.registry.transforms or m == "base64_offset_decode"]
        value = transforms.apply_chain(value, ["base64offset_decode" if m == "base64_offset_decode" else m for m in decoders], self.registry.transforms)
        if "exists" in p.modifiers:
            wanted = values and values[0] == "true"
            return value.isNotNull() if wanted else value.isNull()
        if "windash" in p.modifiers:
            values += [v.replace("-", d, 1) for v in p.values for d in "/–—―" if "-" in v]
        for op in ("gte", "lte", "gt", "lt"):
            if op in p.modifiers:
                return predicates.range_advanced(value, [{"gte": ">=", "lte": "<=", "gt": ">", "lt": "<"}[op] + v for v in values])
        if p.match_type in ("equals", "contains", "startswith", "endswith") and any(not predicates.is_literal(v) for v in values):
            before, after = {"equals": ("", ""), "contains": ("*", "*"), "startswith": ("", "*"), "endswith": ("*", "")}[p.match_type]
            parts = [value.rlike(predicates.wildcard_pattern(before + v + after)) for v in values]
            return (predicates.all_of if "all" in p.modifiers else predicates.any_of)(parts + extra)
        if "all" in p.modifiers and p.match_type != "contains":
            return predicates.all_of([self.registry.matcher(p.match_type)(value, [v], p.modifiers) for v in values])
        return self.registry.matcher(p.match_type)(value, values, p.modifiers)

    def primitive(self, p: Primitive) -> Column:
        """True or false for every event."""
        if p.any_field:
            return predicates.two_valued(F.exists(self.fields.all_values(), lambda v: predicates.two_valued(self._test(v, p))))
        if not p.field:
            return F.lit(False)
        return predicates.two_valued(self._test(self.value(p), p))

    def rule_column(self, rule: Rule, tree: tuple) -> Column:
        at_least = None
        if self.config.mode == "spec":
            at_least = lambda n, parts: reduce(lambda a, b: a + b, [p.cast("int") for p in parts]) >= F.lit(n)
        return condition.fold(tree, rule, lambda i: self.primitive(self.ruleset.primitives[i]), predicates.all_of, predicates.any_of, _not, at_least)

    def matched(self, rules: list[tuple[Rule, tuple]] | None = None) -> Column:
        """Numbers of the rules that match, rising."""
        chosen = sorted(self.rules if rules is None else rules, key=lambda x: x[0].rule_id)
        if not chosen:
            return F.array().cast("array<int>")
        return F.array_compact(F.array(*[F.when(self.rule_column(r, t), F.lit(r.rule_id)) for r, t in chosen])).cast("array<int>")

    # plans
    def evaluate(self, events: DataFrame) -> DataFrame:
        """events with ``matched``, by the plan that the number of rules asks for."""
        if len(self.rules) <= self.config.projection_rules:
            return events.withColumn("matched", self.matched())
        return self.search(events)

    def matches(self, events: DataFrame, key: str = "event_id") -> DataFrame:
        """One row (key, rule_id) a match."""
        return self.evaluate(events).select(key, F.explode("matched").alias("rule_id"))

    def observed(self, events: DataFrame, name: str | None = None) -> tuple[DataFrame, Observation]:
        """Evaluated events, and their counters once an action has run: events, matched events, matches, primitive evaluations."""
        seen = Observation(name or f"evaluation-{uuid.uuid4().hex}")
        n = F.count(F.lit(1))
        counters = (n.alias("events"), F.count_if(F.size("matched") > 0).alias("events_matched"), F.coalesce(F.sum(F.size("matched")), F.lit(0)).alias("matches"), (n * len(self.ruleset.primitives)).alias("primitive_evaluations"))
        return self.evaluate(events).observe(seen, *counters), seen

    # the search plan
    def clauses(self) -> tuple[list[tuple[int, int, int, bool]], list[tuple[Rule, tuple]]]:
        """(rule, clause, primitive, negated) in disjunctive form, and the rules that stay projections."""
        rows, rest = [], []
        for rule, tree in self.rules:
            dnf = _dnf(tree, rule, self.config.mode == "spec")
            if dnf is None or any(all(n for _, n in c) for c in dnf) or any(self.ruleset.primitives[p].any_field for c in dnf for p, _ in c):
                rest.append((rule, tree))
                continue
            for k, clause in enumerate(dnf):
                rows += [(rule.rule_id, k, p, n) for p, n in sorted(clause)]
        return rows, rest

    def _literal_kind(self, p: Primitive) -> str | None:
        """How a primitive's values are looked for in the search; None if it needs a column of its own."""
        own = {"equals": predicates.equals, "exact": predicates.equals, "contains": predicates.contains, "startswith": predicates.startswith, "endswith": predicates.endswith}
        kind = p.match_type.lower()
        if kind == "cidr" and self.registry.matcher(kind) is predicates.cidr and not (self.config.mode == "spec" and p.modifiers):
            return kind
        if kind not in own or self.registry.matcher(kind) is not own[kind]:
            return None
        if "all" in p.modifiers and kind == "contains" and p.values and not (self.config.mode == "spec" and (len(p.modifiers) > 1 or not all(predicates.is_literal(v) for v in p.values))):
            return "all"
        if self.config.mode == "spec" and (set(p.modifiers) - {"case_sensitive"} or not all(predicates.is_literal(v) for v in p.values)):
            return None
        if kind in ("equals", "exact"):
            return "cased" if "case_sensitive" in p.modifiers else "equals"
        return kind

    def _plan(self) -> tuple[literals.Plan, list[str], list[int], list[tuple[Rule, tuple]]]:
        """The search, the fields that it reads, the primitives that are columns, and the rules that stay projections."""
        rows, rest = self.clauses()
        prims = self.ruleset.primitives
        used = sorted({p for _, _, p, _ in rows})
        kinds = {p: self._literal_kind(prims[p]) for p in used if prims[p].field}
        names = sorted({prims[p].field for p, k in kinds.items() if k})
        number = {n: i for i, n in enumerate(names)}
        plan = literals.Plan(uuid.uuid4().hex, clauses=rows)
        for p, k in kinds.items():
            f = number.get(prims[p].field)
            if k == "cidr":
                plan.networks += [(p, f, str(n)) for n in predicates.networks(list(prims[p].values))]
            elif k == "all":
                first = -1 - sum(len(parts) for _, parts in plan.alls)
                parts = tuple(range(first, first - len(prims[p].values), -1))
                plan.alls.append((p, parts))
                plan.literals += [(part, f, "contains", v.lower()) for part, v in zip(parts, prims[p].values, strict=True)]
            elif k:
                plan.literals += [(p, f, k, v if k == "cased" else v.lower()) for v in prims[p].values]
        return plan, names, [p for p, k in kinds.items() if not k], rest

    def search(self, events: DataFrame) -> DataFrame:
        """events with ``matched``; every other column passes through."""
        plan, names, others, rest = self._plan()
        prims = self.ruleset.primitives
        own = [c for c in events.columns if c.lower() != "matched"]
        # fields are read once, whatever number of predicates looks at them
        asked = {p for rule, tree in rest for p in _primitives(rule, tree)} | set(others)
        fields = [*names, *sorted({prims[p].field for p in asked if prims[p].field and not prims[p].any_field} - set(names))]
        read = self.registry.extractor or self.fields.field
        extra = [self.fields.all_values().alias("av")] if any(prims[p].any_field for p in asked) else []
        rows = events.select(*[events[c].alias(f"c{i}") for i, c in enumerate(own)], *[read(n).alias(f"f{i}") for i, n in enumerate(fields)], *extra)
        view = copy.copy(self)
        view.fields = _Extracted({n: f"f{i}" for i, n in enumerate(fields)})
        present = F.filter(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"f{i}").alias("v")) for i in range(len(names))]), lambda x: x["v"].isNotNull()) if names else F.array().cast("array<struct<f:int,v:string>>")
        values = F.transform(present, lambda x: F.struct(x["f"].alias("f"), x["v"].alias("v"), F.lower(x["v"]).alias("low")))
        none = F.array().cast("array<int>")
        columns = [F.array_compact(F.array(*[F.when(view.primitive(prims[p]), F.lit(p)) for p in others[k : k + TOGETHER]])).cast("array<int>") for k in range(0, len(others), TOGETHER)]
        whole = [view.matched(rest[k : k + TOGETHER]) for k in range(0, len(rest), TOGETHER)]
        rows = rows.select(*[f"c{i}" for i in range(len(own))], values.alias("values"), F.concat(none, *columns).alias("hits"), F.concat(none, *whole).alias("whole"))
        schema = T.StructType([*[T.StructField(f"c{i}", events.schema[c].dataType) for i, c in enumerate(own)], T.StructField("matched", T.ArrayType(T.IntegerType()))])
        n = len(own)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = literals.ready(plan)
            for b in batches:
                out = []
                for found, hits, sure in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), b.column(n + 2).to_pylist(), strict=True):
                    have = set(hits)
                    for x in found:
                        have.update(s.in_value(x["f"], x["v"], x["low"]))
                    out.append(sorted(s.matched(have).union(sure)))
                yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(out, pa.list_(pa.int32()))], names=[*b.schema.names[:n], "matched"])

        done = rows.mapInArrow(run, schema)
        return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], "matched")


def _dnf(tree: tuple, rule: Rule, counted: bool = False) -> list[frozenset[tuple[int, bool]]] | None:
    """Alternatives of (primitive, negated) sets; None if there are more than MOST_CLAUSES, or if a count has its real meaning (``counted``).

    The algebra's values are pairs of the form and of its negation's, so negation is a swap.
    """

    class TooMany(Exception):
        pass

    def tidy(cs) -> list:
        kept = list(dict.fromkeys(c for c in cs if not any((p, not n) in c for p, n in c)))
        if len(kept) > MOST_CLAUSES:
            raise TooMany
        return kept

    def product(parts: list[list]) -> list:
        out = [frozenset()]
        for p in parts:
            out = tidy(a | b for a in out for b in p)
        return out

    def both(parts):
        return (product([p[0] for p in parts]), tidy(c for p in parts for c in p[1]))

    def either(parts):
        return (tidy(c for p in parts for c in p[0]), product([p[1] for p in parts]))

    def leaf(pid):
        return ([frozenset([(pid, False)])], [frozenset([(pid, True)])])

    def at_least(n, parts):
        raise TooMany

    try:
        return condition.fold(tree, rule, leaf, both, either, lambda x: (x[1], x[0]), at_least if counted else None)[0]
    except TooMany:
        return None


def rule_table(spark: SparkSession, ruleset: Ruleset) -> DataFrame:
    """Rule metadata as rows, the last of equal numbers."""
    rows = {r.rule_id: (r.rule_id, r.key, r.name, r.title, r.level, r.description) for r in ruleset.rules}
    return spark.createDataFrame(list(rows.values()), "rule_id int, rule_uid string, name string, title string, level string, description string")


def detections(matches: DataFrame, rules: DataFrame, confidence: float = 0.7) -> DataFrame:
    """Matches (with any other columns) with their rule's name (else its title) and severity; unknown rules are kept."""
    meta = rules.select("rule_id", "rule_uid", F.coalesce(F.nullif("name", F.lit("")), F.nullif("title", F.lit(""))).alias("_name"), F.nullif("level", F.lit("")).alias("_level"))
    joined = matches.join(meta, "rule_id", "left")
    return joined.withColumn("rule_name", F.coalesce("_name", F.concat(F.lit("rule-"), F.col("rule_id").cast("string")))).withColumn("severity", F.coalesce("_level", F.lit("medium"))).withColumn("confidence", F.lit(confidence)).drop("_name", "_level")


def enriched(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Stored detections as they are read: with rule_uid, rule_title, rule_level and rule_description of known rules.

    What a detection was stored with has precedence: its name as the title, its severity as the level.
    """
    meta = rules.select("rule_id", F.col("rule_uid"), F.col("title").alias("_title"), F.col("level").alias("_level"), F.col("description").alias("rule_description"), F.lit(True).alias("_known"))
    joined = found.drop("rule_uid").join(meta, "rule_id", "left")
    first = lambda a, b: F.when(F.col("_known"), F.when(F.coalesce(F.col(a), F.lit("")) == "", F.col(b)).otherwise(F.col(a)))
    return joined.withColumn("rule_title", first("rule_name", "_title")).withColumn("rule_level", first("severity", "_level")).drop("_title", "_level", "_known")


def event_rule_links(matches: DataFrame, rules: DataFrame, key: str = "event_id") -> DataFrame:
    """One row of each event and known rule."""
    return matches.select(key, "rule_id").distinct().join(rules.select("rule_id", "rule_uid"), "rule_id").select(key, "rule_id", "rule_uid")


def batch_threshold(matches: DataFrame, group_by: list[str], gte: int) -> DataFrame:
    """Matches counted by rule and group over the whole batch; a missing group field counts as N/A."""
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("N/A")).alias(g) for g in group_by]
    return matches.select("rule_id", *keys).groupBy("rule_id", *group_by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= gte)


def required_literals(ruleset: Ruleset, rule: Rule, tree: tuple) -> set[str] | None:
    """Texts one of which every matching event holds in some form, lower case; None where nothing is implied."""
    dnf = _dnf(tree, rule)
    if dnf is None:
        return None
    out: set[str] = set()
    for clause in dnf:
        best = None
        for pid, negated in clause:
            p = ruleset.primitives[pid]
            if negated or p.any_field or p.match_type not in ("equals", "exact", "contains", "startswith", "endswith"):
                continue
            values = {v.lower() for v in p.values if v and v.isascii() and '"' not in v and "\\" not in v and v.isprintable() and "/" not in v}
            if len(values) == len(set(p.values)) and (best is None or len(values) < len(best)):
                best = values
        if best is None:
            return None
        out |= best
    return out


def prefilter(engine: Engine, text: Column) -> Column:
    """A test on an event's raw text that no matching event fails: it may be put before the rules.

    Only rules whose literals are implied take part; if any other rule exists, everything passes.
    """
    needles: set[str] = set()
    for rule, tree in engine.rules:
        own = required_literals(engine.ruleset, rule, tree)
        if own is None:
            return F.lit(True)
        needles |= own
    return predicates.any_of([F.lower(text).contains(v) for v in sorted(needles)])


def prefilter_worthwhile(patterns: int, selectivity: float) -> dict[str, bool]:
    """The two readings of effectiveness: recommended, and at all useful."""
    return {"recommended": patterns >= 5 and selectivity < 0.7, "useful": patterns >= 1 and selectivity < 0.8}


def literal_primitives(engine: Engine) -> dict[str, list[int]]:
    """Literals that the ruleset looks for, in lower case, with the numbers of the primitives that have them."""
    out: dict[str, list[int]] = {}
    for i, p in enumerate(engine.ruleset.primitives):
        if engine.registry.context(p).literal_only:
            for v in p.values:
                if v and i not in out.setdefault(v.lower(), []):
                    out[v.lower()].append(i)
    return out


def literal_occurrences(text: Column, found: dict[str, list[int]]) -> Column:
    """array<struct<literal, start, stop, primitives>> of literals in a text, in any letter case and overlapping, for diagnosis; ``start`` from 0."""
    kind = "array<struct<literal:string,start:int,stop:int,primitives:array<int>>>"

    @F.pandas_udf(kind)
    def occurrences(texts: pd.Series) -> pd.Series:
        find = literals.automaton({w: (w, ps) for w, ps in found.items()})
        spots = lambda t: sorted((end - len(w) + 1, end + 1, w, ps) for end, (w, ps) in find(t)) if t else []
        return texts.map(lambda t: [{"literal": w, "start": a, "stop": b, "primitives": ps} for a, b, w, ps in spots(t)])

    return occurrences(F.lower(text))


def report(dropped: list[Dropped]) -> str:
    return "\n".join(f"{d.key}: {d.reason}" for d in dropped)
