"""Probabilistic record linkage of documents to members and authorizations.

Each document gets its best candidate over *all* targets, exactly, without
comparing pairs.  A candidate's score depends only on which fields agree, so
for every set of fields the targets are reduced to one row per key (the
smallest id), and each distinct combination of field values looks its own keys
up once, however many documents have it.  Agreement weighs more than
disagreement, hence the best-scoring hit of a combination is the best candidate
of its documents.  The work is linear in documents plus targets whatever the
key distribution.

Lookups go by a 64-bit hash of the key, with the true key compared on the hit.
Combinations, index and answers are written once: both sides of every join are
then plain scans behind an exchange, so adaptive execution can split a hot
value, and only numbers are aggregated, which keeps to hash tables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.functions.exact import n_where, pct
from caselight.functions.exprs import fs_weights, link_confidence, match_class
from caselight.operators.joins import HOT_KEY_SAMPLE, balanced_lookup
from caselight.session import materialize


@dataclass(frozen=True)
class Compare:
    """One compared field and its agreement probabilities."""

    name: str
    m: float
    u: float
    mult: float = 1.0

    @property
    def weights(self) -> tuple[float, float]:
        agree, disagree = fs_weights(self.m, self.u)
        return agree * self.mult, disagree * self.mult


# Agreement probabilities (m, u) and class thresholds.
MEMBER_FIELDS = (
    Compare("name", 0.89, 0.015),
    Compare("dob", 0.92, 0.005),
    Compare("ssn4", 0.95, 0.001),
)
AUTH_FIELDS = (
    Compare("auth_id", 0.92, 0.01),
    Compare("service_date", 0.80, 0.05),
)
MEMBER_THRESHOLDS = (8.0, 3.0)
AUTH_THRESHOLDS = (6.0, 2.0)
# A place, a target number and a field set share 63 bits.
MOST_FIELDS = 5
TARGET_BITS = 53
MOST_TARGETS = 1 << TARGET_BITS
MEMBER_CONFIDENCE_SCALE = 15.0
AUTH_CONFIDENCE_SCALE = 10.0


def _subsets(n: int) -> list[tuple[int, ...]]:
    return [s for size in range(n, 0, -1) for s in combinations(range(n), size)]


def _keys(df_cols: Sequence[Column], subset: Sequence[int]) -> list[Column]:
    return [
        (c.cast("string") if i in subset else F.lit("")).alias(f"_k{i}") for i, c in enumerate(df_cols)
    ]


def _agreement_rows(cols: Sequence[Column]) -> Column:
    """One struct per field set whose fields are all present, NULL for the others."""
    rows = []
    for subset in _subsets(len(cols)):
        there = cols[subset[0]].isNotNull()
        for i in subset[1:]:
            there = there & cols[i].isNotNull()
        code = F.lit(sum(1 << i for i in subset)).alias("_set")
        rows.append(F.when(there, F.struct(code, *_keys(cols, subset))))
    return F.array(*rows)


def _keyed_sets(df: DataFrame, keep: Sequence[str], cols: Sequence[Column]) -> DataFrame:
    """``keep`` and one row per set of present fields: its code, the set and the values, empty outside of it."""
    k = [f"_k{i}" for i in range(len(cols))]
    rows = df.select(*keep, F.explode(_agreement_rows(cols)).alias("_p")).where(F.col("_p").isNotNull())
    return rows.select(*keep, F.xxhash64("_p._set", *[f"_p.{c}" for c in k]).alias("_code"), "_p.*")


def _packed(fields: Sequence[Compare]) -> Column:
    """Place of the total weight (heaviest first), then target number, then field set, in one integer."""
    size = 1 << len(fields)
    places = []
    for mask in range(size):
        sums = [round(_sum(fields, code, mask), 9) for code in range(size)]
        order = sorted(set(sums), reverse=True)
        places += [F.lit(order.index(x)).cast("long") for x in sums]
    place = F.element_at(F.array(*places), F.col("_there") * size + F.col("_set") + 1)
    number = F.when(F.col("_t") < MOST_TARGETS, F.col("_t")).otherwise(F.raise_error(F.lit("too many partitions")).cast("long"))
    return F.shiftleft(place, TARGET_BITS + len(fields)) + F.shiftleft(number, len(fields)) + F.col("_set")


def _sum(fields: Sequence[Compare], code: int, mask: int) -> float:
    """Weight of the fields in ``mask`` when those in ``code`` agree."""
    return sum((f.weights[0] if code >> i & 1 else f.weights[1]) for i, f in enumerate(fields) if mask >> i & 1)


def _total(fields: Sequence[Compare], agreed: Column, there: Column) -> Column:
    """Total weight for a set of agreeing fields among those present, from a table of 4**k sums."""
    size = 1 << len(fields)
    table = F.array(*[F.lit(float(_sum(fields, c, m))) for m in range(size) for c in range(size)])
    return F.element_at(table, there * size + agreed + 1)


def _weight(field: Compare, i: int, agreed: Column, there: Column) -> Column:
    yes, no = field.weights
    return F.when(~there, 0.0).when(agreed.bitwiseAND(F.lit(1 << i)) != 0, yes).otherwise(no)


def best_links(
    docs: DataFrame,
    targets: DataFrame,
    doc_key: str,
    target_key: str,
    fields: Sequence[Compare],
    carry: Sequence[str] = (),
    hot_rows: int | None = None,
    fraction: float = HOT_KEY_SAMPLE,
) -> DataFrame:
    """Best target per document: doc_key, carry, target_key, <field>_weight, total_weight.

    ``docs`` and ``targets`` hold one column per field name; NULL means the
    field was not read and weighs nothing.  Ties go to the smallest target id.
    Documents without any field present score 0 with every target.
    """
    if any(f.weights[0] <= f.weights[1] for f in fields):
        raise ValueError("a field must weigh more when it agrees than when it does not")
    if len(fields) > MOST_FIELDS:
        raise ValueError(f"at most {MOST_FIELDS} fields")
    names = [f.name for f in fields]
    cols = [F.col(n) for n in names]
    k = [f"_k{i}" for i in range(len(fields))]
    probe = ["_code", "_set", *k]
    own = ["_combination", "_there", *k]
    mask = sum((F.when(c.isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(cols)), F.lit(0))
    text = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in zip(cols, k)]

    keyed = docs.select(doc_key, *carry, mask.alias("_there"), *text)
    keyed = keyed.withColumn("_combination", F.xxhash64("_there", *k))
    combinations_ = materialize(
        keyed.select(*own).distinct().withColumn("_c", F.monotonically_increasing_id()), "combinations"
    )
    present = [F.when(F.col("_there").bitwiseAND(F.lit(1 << i)) != 0, F.col(c)) for i, c in enumerate(k)]
    probes = _keyed_sets(combinations_.where("_there > 0"), ["_c", "_there"], present)

    # Targets are numbered in the order of their ids, so the smallest id is the smallest number.
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = targets.select(target_key, *names).repartitionByRange(n_parts, target_key).sortWithinPartitions(target_key)
    numbered = materialize(numbered.withColumn("_t", F.monotonically_increasing_id()), "targets")
    index = materialize(
        _keyed_sets(numbered.where(F.col(target_key).isNotNull()), ["_t"], cols).groupBy(*probe).agg(F.min("_t").alias("_t")), "index"
    )
    found = probes.join(index, probe).groupBy("_c").agg(F.min(_packed(fields)).alias("_best"))
    answers = found.select(
        "_c",
        F.shiftright("_best", len(fields)).bitwiseAND(F.lit(MOST_TARGETS - 1)).alias("_t"),
        F.col("_best").bitwiseAND(F.lit((1 << len(fields)) - 1)).cast("int").alias("_agreed"),
    )
    named = materialize(answers, "answers").join(numbered.select("_t", target_key), "_t").drop("_t")
    index_rows = combinations_.join(named, "_c", "left").select(*own, target_key, F.coalesce("_agreed", F.lit(0)).alias("_agreed"))
    looked_up = balanced_lookup(keyed, materialize(index_rows, "links"), own, doc_key, hot_rows, fraction)
    # Nothing agrees anywhere: all targets score alike and the smallest id wins.
    anyone = targets.select(F.min(target_key)).scalar()
    linked = looked_up.withColumn(target_key, F.coalesce(F.col(target_key), anyone))
    weights = [
        F.round(
            _weight(f, i, F.col("_agreed"), F.col("_there").bitwiseAND(F.lit(1 << i)) != 0), 4
        ).alias(f"{f.name}_weight")
        for i, f in enumerate(fields)
    ]
    total = F.round(_total(fields, F.col("_agreed"), F.col("_there")), 4).alias("total_weight")
    return linked.select(doc_key, *carry, target_key, *weights, total)


def full_name(first: Column, last: Column) -> Column:
    return F.lower(F.trim(F.concat_ws(" ", first, last)))


def link_members(
    structured: DataFrame,
    members: DataFrame,
    fields: Sequence[Compare] = MEMBER_FIELDS,
    thresholds: tuple[float, float] = MEMBER_THRESHOLDS,
    **split,
) -> DataFrame:
    """Member candidate of every structured document (one row each)."""
    docs, targets = member_evidence(structured, members)
    linked = best_links(
        docs, targets, "doc_id", "candidate_member_id", fields, ["pipeline_run_ts", "payer_code"], **split
    )
    return linked.select(
        "doc_id",
        "candidate_member_id",
        "name_weight",
        "dob_weight",
        "ssn4_weight",
        "total_weight",
        match_class(F.col("total_weight"), *thresholds).alias("match_class"),
        "pipeline_run_ts",
        "payer_code",
    )


def link_auths(
    structured: DataFrame,
    auths: DataFrame,
    fields: Sequence[Compare] = AUTH_FIELDS,
    thresholds: tuple[float, float] = AUTH_THRESHOLDS,
    **split,
) -> DataFrame:
    """Authorization candidate of every document that names an id or a service date."""
    docs = structured.where(
        F.col("auth_id").isNotNull() | F.col("service_date_on_form").isNotNull()
    ).select(
        "doc_id",
        "auth_id",
        F.col("service_date_on_form").cast("string").alias("service_date"),
        F.col("extraction_ts").alias("pipeline_run_ts"),
        "payer_code",
    )
    targets = auths.select(
        F.col("auth_id").alias("candidate_auth_id"),
        "auth_id",
        F.col("service_from_date").cast("string").alias("service_date"),
    )
    linked = best_links(
        docs, targets, "doc_id", "candidate_auth_id", fields, ["pipeline_run_ts", "payer_code"], **split
    )
    return linked.select(
        "doc_id",
        "candidate_auth_id",
        "auth_id_weight",
        "service_date_weight",
        "total_weight",
        match_class(F.col("total_weight"), *thresholds).alias("match_class"),
        "pipeline_run_ts",
        "payer_code",
    )


def best_candidate(candidates: DataFrame, entity: str) -> DataFrame:
    """Highest weight per document, ties by id, from any candidate table."""
    others = [c for c in candidates.columns if c not in ("doc_id", entity, "total_weight")]
    row = F.struct(
        (-F.col("total_weight")).alias("_neg"), F.col(entity), *[F.col(c) for c in others]
    )
    picked = candidates.groupBy("doc_id").agg(F.min(row).alias("_b"))
    return picked.select(
        "doc_id", f"_b.{entity}", (-F.col("_b._neg")).alias("total_weight"), *[f"_b.{c}" for c in others]
    ).select(*candidates.columns)


def match_events(member_links: DataFrame, auth_links: DataFrame) -> DataFrame:
    """One event per confirmed link of either kind."""

    def events(links: DataFrame, entity: str, kind: str, scale: float) -> DataFrame:
        return links.where(F.col("match_class") == "match").select(
            F.md5(F.concat_ws("|", F.lit(kind), "doc_id", entity)).alias("event_id"),
            "doc_id",
            F.lit(kind).alias("event_type"),
            F.col(entity).alias("matched_entity_id"),
            link_confidence(F.col("total_weight"), scale).alias("confidence"),
            F.col("pipeline_run_ts").alias("event_ts"),
        )

    return events(
        member_links, "candidate_member_id", "member_match_confirmed", MEMBER_CONFIDENCE_SCALE
    ).unionByName(
        events(auth_links, "candidate_auth_id", "auth_match_confirmed", AUTH_CONFIDENCE_SCALE)
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def dq_summary(parsed: DataFrame, structured: DataFrame, candidates: DataFrame, batch: Column) -> DataFrame:
    """Data-quality row per batch; ``batch`` is an expression over ``ingest_ts``."""
    docs = parsed.select("doc_id", "unreadable_flag", "parse_error_status", "ingest_ts").withColumn(
        "batch_id", batch
    )
    joined = docs.join(structured.select("doc_id", "missing_dob", "missing_ssn4"), "doc_id", "left").join(
        best_candidate(candidates, "candidate_member_id").select("doc_id", "match_class"), "doc_id", "left"
    )
    cls = F.col("match_class")
    scored = F.count(cls)
    rows = F.count(F.lit(1))
    return joined.groupBy("batch_id").agg(
        F.max("ingest_ts").alias("run_ts"),
        rows.alias("total_docs"),
        pct(n_where(F.col("unreadable_flag")), rows).alias("pct_unreadable"),
        pct(n_where(F.col("missing_dob")), rows).alias("pct_missing_dob"),
        pct(n_where(F.col("missing_ssn4")), rows).alias("pct_missing_ssn4"),
        n_where(F.col("parse_error_status").isNotNull()).alias("parse_errors"),
        pct(n_where(cls == "match"), scored).alias("pct_match"),
        pct(n_where(cls == "possible_match"), scored).alias("pct_possible_match"),
        pct(n_where(cls == "non_match"), scored).alias("pct_non_match"),
    )


def agreement_patterns(docs: DataFrame, targets: DataFrame, names: Sequence[str]) -> DataFrame:
    """How many (document, target) pairs agree on exactly which fields.

    Columns: ``there`` and ``agreed`` (bit sets of ``names``) and ``pairs``.
    Pairs that agree on at least a set are the products of the row counts per
    key on both sides; inclusion and exclusion turns them into exact sets.  No
    pair is formed, and the result has at most 3**k rows.
    """
    size = 1 << len(names)
    cols = [F.col(n) for n in names]
    keys = [f"_k{i}" for i in range(len(names))]
    mask = sum((F.when(c.isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(cols)), F.lit(0))
    nothing = F.struct(F.lit(0).alias("_set"), *[F.lit("").alias(k) for k in keys])

    def counted(df: DataFrame, by: Sequence[str]) -> DataFrame:
        # Rows with equal fields are folded before their sets are listed.
        folded = df.groupBy(*names).agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("_n"))
        sets = F.explode(F.concat(_agreement_rows(cols), F.array(nothing))).alias("_p")
        return (
            folded.select(mask.alias("there"), "_n", sets)
            .where(F.col("_p").isNotNull())
            .select("there", "_n", "_p.*")
            .groupBy(*by, "_set", *keys)
            .agg(F.sum("_n").cast("decimal(38,0)").alias("_n"))
        )

    left = counted(docs, ["there"])
    right = counted(targets, []).withColumnRenamed("_n", "_m")
    product = (F.col("_n") * F.col("_m")).cast("decimal(38,0)")
    at_least = left.join(right, ["_set", *keys]).groupBy("there", "_set").agg(
        F.sum(product).cast("decimal(38,0)").alias("_pairs")
    )
    subset = F.explode(
        F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda s: s.bitwiseAND(F.col("_set")) == s)
    )
    odd = F.bit_count(F.col("_set").bitwiseXOR(F.col("agreed"))) % 2 == 1
    return (
        at_least.select("there", "_set", "_pairs", subset.alias("agreed"))
        .groupBy("there", "agreed")
        .agg(F.sum(F.when(odd, -F.col("_pairs")).otherwise(F.col("_pairs"))).alias("pairs"))
        .where(F.col("pairs") > 0)
    )


def estimate_mu(
    patterns: DataFrame, names: Sequence[str], iterations: int = 1_000, tolerance: float = 1e-14
) -> DataFrame:
    """Agreement probabilities per field by expectation maximisation: field, m, u, rounds, converged, log_likelihood.

    Spark counts the pairs; the iteration itself runs over those at most 3**k
    counts, until a round adds less than ``tolerance`` of it to the log
    likelihood or ``iterations`` rounds were made, which ``converged`` tells apart.
    """
    rows = [(r["there"], r["agreed"], float(r["pairs"])) for r in patterns.orderBy("there", "agreed").collect()]
    m, u, trace = fit_mu(rows, len(names), iterations, tolerance)
    rounds = len(trace) - 1
    done = rounds < iterations or _settled(trace, tolerance)
    spark = patterns.sparkSession
    structs = [
        F.struct(
            F.lit(n).alias("field"), F.lit(a).alias("m"), F.lit(b).alias("u"), F.lit(rounds).alias("rounds"),
            F.lit(done).alias("converged"), F.lit(trace[-1]).alias("log_likelihood"),
        )
        for n, a, b in zip(names, m, u)
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def _settled(trace: Sequence[float], tolerance: float) -> bool:
    return len(trace) > 1 and trace[-1] - trace[-2] <= tolerance * abs(trace[-1])


def fit_mu(
    rows: Sequence[tuple[int, int, float]], k: int, iterations: int, tolerance: float
) -> tuple[list[float], list[float], list[float]]:
    """m, u and the log likelihood before each round and after the last; it never falls."""
    m, u, share = [0.9] * k, [0.05] * k, 1e-3

    def parts(there: int, agreed: int) -> tuple[float, float]:
        pm, pu = share, 1 - share
        for i in range(k):
            if there >> i & 1:
                yes = agreed >> i & 1
                pm *= m[i] if yes else 1 - m[i]
                pu *= u[i] if yes else 1 - u[i]
        return pm, pu

    def likelihood() -> float:
        return math.fsum(n * math.log(sum(parts(there, agreed))) for there, agreed, n in rows)

    total = math.fsum(n for _, _, n in rows)
    trace = [likelihood()]
    for _ in range(iterations if rows else 0):
        hit, hit_there, miss, miss_there = ([0.0] * k for _ in range(4))
        matched = 0.0
        for there, agreed, n in rows:
            pm, pu = parts(there, agreed)
            g = pm / (pm + pu) if pm + pu > 0 else 0.0
            matched += n * g
            for i in range(k):
                if there >> i & 1:
                    hit_there[i] += n * g
                    miss_there[i] += n * (1 - g)
                    if agreed >> i & 1:
                        hit[i] += n * g
                        miss[i] += n * (1 - g)
        share = min(max(matched / total, 1e-12), 1 - 1e-12)
        for i in range(k):
            if hit_there[i] > 0:
                m[i] = min(max(hit[i] / hit_there[i], 1e-9), 1 - 1e-9)
            if miss_there[i] > 0:
                u[i] = min(max(miss[i] / miss_there[i], 1e-9), 1 - 1e-9)
        trace.append(likelihood())
        if _settled(trace, tolerance):
            break
    return m, u, trace


def member_evidence(structured: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The compared fields of both sides, under one name each."""
    docs = structured.select(
        "doc_id",
        F.lower(F.trim("name_on_form")).alias("name"),
        F.col("dob_extracted").alias("dob"),
        F.col("ssn4_extracted").alias("ssn4"),
        F.col("extraction_ts").alias("pipeline_run_ts"),
        "payer_code",
    )
    targets = members.select(
        F.col("member_id").alias("candidate_member_id"),
        full_name(F.col("first_name"), F.col("last_name")).alias("name"),
        F.col("dob").cast("string").alias("dob"),
        "ssn4",
    )
    return docs, targets
