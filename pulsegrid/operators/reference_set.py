"""Reference sets: membership, dimension policies, evaluations, lineage of revisions, reviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators import gate
from pulsegrid.operators.keys import join
from pulsegrid.shared import stored

MOST_MEMBERS = 32


def numbered_members(members: DataFrame) -> DataFrame:
    """ref_0001 and on, per revision by report_bundle_id."""
    k = F.row_number().over(Window.partitionBy("revision_id").orderBy("report_bundle_id"))
    return members.withColumn("membership_id", F.format_string("ref_%04d", k))


def member_limits(members: DataFrame, most: int = MOST_MEMBERS) -> DataFrame:
    """Per revision: size, and whether it is between 1 and ``most`` without repeats."""
    out = members.groupBy("revision_id").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("report_bundle_id").alias("bundles"))
    return out.withColumn("valid", (F.col("members") <= most) & (F.col("members") == F.col("bundles")))


def evaluation_pairs(members: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target (target_id, revision_id) with every member of its revision: one row per pair; a target that is a member is left out."""
    m = members.select("revision_id", F.col("report_bundle_id").alias("reference_id"))
    inside = targets.join(m, (targets.revision_id == m.revision_id) & (F.col("target_id") == F.col("reference_id")), "left_semi")
    return targets.join(inside, ["target_id", "revision_id"], "left_anti").join(m, "revision_id")


def anchor_pairs(members: DataFrame) -> DataFrame:
    """Each member with the first one of its revision."""
    first = members.groupBy("revision_id").agg(F.min("report_bundle_id").alias("reference_id"))
    return members.join(first, "revision_id").where("report_bundle_id <> reference_id").select("revision_id", "reference_id", F.col("report_bundle_id").alias("target_id"))


def creation_check(members: DataFrame, runs: DataFrame) -> DataFrame:
    """Per revision: whether all members are compatible with the anchor."""
    pairs = anchor_pairs(members)
    found = gate.compatibility(gate.checks(pairs.select("reference_id", "target_id").distinct(), runs))
    return pairs.join(found, ["reference_id", "target_id"]).groupBy("revision_id").agg(F.bool_and("compatible").alias("compatible"), F.count_if(~F.col("compatible")).alias("incompatible"))


def field_counts(fields: DataFrame) -> DataFrame:
    """Per target, topic and field that changed against some reference: eligible, changed, unchanged, scope.

    A reference is eligible where the topic is common, which is where ``fields`` has rows of it.
    """
    eligible = fields.groupBy("target_id", "topic").agg(F.count_distinct("reference_id").alias("eligible"))
    changed = fields.groupBy("target_id", "topic", "field").agg(F.count_if("changed").alias("changed")).where("changed > 0")
    out = changed.join(eligible, ["target_id", "topic"])
    return out.withColumns({"unchanged": F.col("eligible") - F.col("changed"), "scope": F.when(F.col("changed") == F.col("eligible"), "all").otherwise("some")})


def topic_counts(pairs: DataFrame, sides: DataFrame) -> DataFrame:
    """Per target and topic: in how many references it is common, target_only, reference_only or absent (the rest)."""
    total = pairs.groupBy("target_id").agg(F.count_distinct("reference_id").alias("references"))
    seen = sides.groupBy("target_id", "topic").agg(*[F.count_if(F.col("side") == s).alias(s) for s in ("common", "target_only", "reference_only")])
    return seen.join(total, "target_id").withColumn("absent", F.col("references") - F.col("common") - F.col("target_only") - F.col("reference_only"))


def evaluation_summary(fields_seen: DataFrame, topics_seen: DataFrame) -> DataFrame:
    """Per target: topics, changed topics, field records, and how many of these hold for all or some references."""
    t = topics_seen.groupBy("target_id").agg(F.count(F.lit(1)).alias("topics"), F.max("references").alias("references"))
    f = fields_seen.groupBy("target_id").agg(F.count_distinct("topic").alias("changed_topics"), F.count(F.lit(1)).alias("field_records"), F.count_if(F.col("scope") == "all").alias("scope_all"), F.count_if(F.col("scope") == "some").alias("scope_some"))
    return t.join(f, "target_id", "left").na.fill(0)


def admitted(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """The pairs of those targets of which every pair is compatible."""
    found = gate.compatibility(gate.checks(pairs.select("reference_id", "target_id").distinct(), runs))
    blocked = found.where(~F.col("compatible")).select("target_id").distinct()
    return pairs.join(blocked, "target_id", "left_anti")


def policy_violations(subjects: DataFrame) -> DataFrame:
    """Codes of broken dimension rules per subject.

    ``subjects``: subject_id, dimensions map, match_values map, vary_keys, required_keys and axis_keys arrays. Required
    keys must be there, match_values equal; axis keys may vary, aren't matched, and have a value.
    """
    keys = F.map_keys("dimensions")
    rules = {
        "required_missing": F.size(F.array_except("required_keys", keys)) > 0,
        "match_differs": F.exists(F.map_entries("match_values"), lambda e: ~e["value"].eqNullSafe(F.try_element_at("dimensions", e["key"]))),
        "axis_not_varying": F.size(F.array_except("axis_keys", "vary_keys")) > 0,
        "axis_is_matched": F.arrays_overlap("axis_keys", F.map_keys("match_values")),
        "axis_without_value": F.size(F.array_except("axis_keys", keys)) > 0,
    }
    return subjects.select("subject_id", F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()])).alias("violations"))


#: Nodes at most whose paths are followed by doubling; more are hooked together first.
FEW = 100_000


def _doubled(up: DataFrame, keys: list[str]) -> DataFrame:
    """``_endless`` for few nodes.

    Each round doubles the length of known paths and is written to the shared folder, so the plan stays flat; a chain
    of n rows takes log2(n) rounds. It ends when no path ends that hadn't before.
    """
    last = None
    while True:
        up = stored(up.where("at is not null"), "paths")
        left = up.count()
        if left == last or left == 0:
            return up.select(*keys, "node")
        last = left
        step = up.select(*keys, F.col("node").alias("at"), F.col("at").alias("next"))
        up = join(up, step, [*keys, "at"], "left").select(*keys, "node", F.col("next").alias("at"))


def _endless(up: DataFrame, keys: list[str]) -> DataFrame:
    """The nodes (keys, node) whose path never ends, if each node has one row (keys, node, at); ``at`` is null at an end.

    While there are more than ``FEW`` nodes, each round tosses a coin for every node, by a hash. A node with tails before
    one with heads is hooked to it, as both end or neither does, and goes; those before it now come before the other.
    Heads stay, so only rows before a node with tails are looked up, and about a quarter of the nodes goes in a round:
    all rounds together hold a few rows a node, however long the chains. Nodes that come before themselves are set
    apart. The hooked nodes are told from what they were hooked to, the last ones first.
    """
    kind = up.select("node").union(up.select("at")).schema[0].dataType  # one type, as hashes differ between types
    up = up.select(*keys, F.col("node").cast(kind).alias("node"), F.col("at").cast(kind).alias("at")).where("at is not null")
    hooked, own = [], []
    up = stored(up, "paths")
    loop = F.col("node") == F.col("at")
    while up.where(~loop).count() > FEW:
        heads = lambda c, k=len(hooked): F.xxhash64(F.lit(k), F.col(c)).bitwiseAND(F.lit(1)) == 0
        own.append(up.where(loop).select(*keys, "node"))
        gone = up.where(~loop & ~heads("node") & heads("at"))
        hooked.append(gone)
        kept = up.where(~loop & (heads("node") | ~heads("at")))
        step = gone.select(*keys, F.col("node").alias("at"), F.col("at").alias("next"))
        moved = join(kept.where(~heads("at")), step, [*keys, "at"], "left").select(*keys, "node", F.coalesce("next", "at").alias("at"))
        up = stored(kept.where(heads("at")).union(moved), "paths")
    if not hooked:
        return _doubled(up, keys)
    rest = up.where(~loop)
    own.append(up.where(loop).select(*keys, "node"))
    own = stored(reduce(DataFrame.union, own), "own")
    before = join(rest.select(*keys, "at").distinct(), own.withColumnRenamed("node", "at"), [*keys, "at"])
    base = _doubled(rest.union(before.select(*keys, F.col("at").alias("node"), "at")), keys)
    found = [own, join(base, own, [*keys, "node"], "left_anti")]
    if not any(f.head(1) for f in found):
        return own
    for gone in reversed(hooked):
        so_far = reduce(DataFrame.union, found).withColumnRenamed("node", "at")
        found.append(stored(join(gone, so_far, [*keys, "at"]).select(*keys, "node"), "endless"))
    return reduce(DataFrame.union, found)


def unrooted(rows: DataFrame, keys: list[str], node: str, parent: str) -> DataFrame:
    """The distinct (keys, node) from which no path of parents ends, within their keys: those on a cycle and those above one.

    Repeated rows count once. Where rows give a node several parents, one is followed at a time, so what is held is a
    row a node: those that lead nowhere are tried again with a parent that has been found to end, until none has one.
    """
    edges = stored(rows.select(*keys, F.col(node).alias("node"), F.col(parent).alias("at")).distinct(), "edges")
    nodes = edges.select(*keys, F.col("node").alias("at")).distinct().withColumn("_node", F.lit(True))
    # a parent that is no node ends a path as none does
    ends = join(edges.where("at is not null"), nodes, [*keys, "at"], "left").select(*keys, "node", F.when(F.col("_node"), F.col("at")).alias("at"))
    edges = stored(ends.union(edges.where("at is null").select(*keys, "node", "at")), "edges")
    left = edges
    while True:
        # nulls, which are ends, first
        chosen = left.groupBy(*keys, "node").agg(F.min(F.struct(F.col("at").isNotNull(), "at")).alias("m"), F.count(F.lit(1)).alias("parents")).select(*keys, "node", "m.at", "parents")
        endless = stored(join(_endless(chosen.drop("parents"), keys), chosen.select(*keys, "node", "parents"), [*keys, "node"]), "endless")
        several = endless.where("parents > 1")
        if not several.head(1):
            return endless.select(*keys, F.col("node").alias(node))
        still = endless.select(*keys, "node", F.lit(True).alias("_endless"))
        own = join(left, endless.select(*keys, "node"), [*keys, "node"])
        known = join(own, still.withColumnsRenamed({"node": "at"}), [*keys, "at"], "left")
        after = stored(known.select(*keys, "node", F.when(F.col("_endless"), F.col("at")).alias("at")), "edges")
        if not after.where("at is null").head(1):
            return endless.select(*keys, F.col("node").alias(node))
        left = after


def lineage(revisions: DataFrame) -> DataFrame:
    """Codes per baseline of its revision tree: roots, unknown parents, revisions that no root leads to (a cycle).

    Rows that say the same count once; ``audit.duplicates`` lists repeated ids.
    """
    r = revisions.select("baseline_id", "revision_id", "parent_revision_id").distinct()
    known = r.select("baseline_id", F.col("revision_id").alias("parent_revision_id"))
    unknown = r.where("parent_revision_id is not null").join(known, ["baseline_id", "parent_revision_id"], "left_anti")
    cyclic = unrooted(r, ["baseline_id"], "revision_id", "parent_revision_id").groupBy("baseline_id").agg(F.count(F.lit(1)).alias("unreachable"))
    roots = r.groupBy("baseline_id").agg(F.count_if(F.col("parent_revision_id").isNull()).alias("roots"), F.count(F.lit(1)).alias("revisions"))
    out = roots.join(unknown.groupBy("baseline_id").agg(F.count(F.lit(1)).alias("unknown_parents")), "baseline_id", "left").join(cyclic, "baseline_id", "left").na.fill(0)
    return out.withColumn("valid", (F.col("roots") == 1) & (F.col("unknown_parents") == 0) & (F.col("unreachable") == 0))


def current_revision(baselines: DataFrame, revisions: DataFrame) -> DataFrame:
    """The named current revision of each baseline; found is false where it isn't stored."""
    r = revisions.select("baseline_id", F.col("revision_id").alias("current_revision_id"), F.lit(True).alias("found"))
    return baselines.join(r, ["baseline_id", "current_revision_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def reference_violations(reviews: DataFrame, evaluations: DataFrame, revisions: DataFrame) -> DataFrame:
    """Foreign keys that lead nowhere, and reviews whose evaluation is of another revision."""
    a = evaluations.join(revisions.select("revision_id").distinct(), "revision_id", "left_anti").select(F.col("evaluation_id").alias("record_id"), F.lit("evaluation_revision_unknown").alias("code"))
    b = reviews.join(evaluations.select("evaluation_id").distinct(), "evaluation_id", "left_anti").select(F.col("review_id").alias("record_id"), F.lit("review_evaluation_unknown").alias("code"))
    c = reviews.join(evaluations.select("evaluation_id", F.col("revision_id").alias("_of")), "evaluation_id").where("revision_id <> _of").select(F.col("review_id").alias("record_id"), F.lit("review_revision_differs").alias("code"))
    return a.union(b).union(c)


def review_chains(reviews: DataFrame) -> DataFrame:
    """Per subject: the effective review, the one that none supersedes, and codes of broken chains.

    ``reviews``: review_id, subject, supersedes_review_id. A chain has one root, one terminal, no fork, no cycle and no
    link to itself, to an unknown review or to another subject's. Rows that say the same count once. Without any code the terminal is the effective one.
    """
    r = reviews.select("review_id", "subject", "supersedes_review_id").distinct()
    linked = r.where("supersedes_review_id is not null")
    superseded = linked.select(F.col("supersedes_review_id").alias("review_id")).distinct()
    terminal = r.join(superseded, "review_id", "left_anti").groupBy("subject").agg(F.count(F.lit(1)).alias("terminals"), F.max("review_id").alias("terminal"))
    forks = linked.groupBy("subject", "supersedes_review_id").count().where("count > 1").groupBy("subject").agg(F.count(F.lit(1)).alias("forks"))
    before = r.select(F.col("review_id").alias("supersedes_review_id"), F.col("subject").alias("_before")).distinct()
    found = linked.join(before, "supersedes_review_id", "left").groupBy("subject").agg(F.count_if(F.col("_before").isNull()).alias("unknown"), F.count_if(F.col("subject") != F.col("_before")).alias("moved"))
    cyclic = unrooted(r, [], "review_id", "supersedes_review_id").join(r.select("review_id", "subject").distinct(), "review_id").groupBy("subject").agg(F.count(F.lit(1)).alias("cyclic"))
    out = r.groupBy("subject").agg(F.count_if(F.col("supersedes_review_id").isNull()).alias("roots"), F.count_if(F.col("supersedes_review_id") == F.col("review_id")).alias("self_links"))
    for part in (terminal, forks, found, cyclic):
        out = join(out, part, ["subject"], "left")
    out = out.na.fill(0, ["terminals", "forks", "unknown", "moved", "cyclic"])
    rules = {
        "roots": F.col("roots") != 1,
        "terminals": F.col("terminals") != 1,
        "fork": F.col("forks") > 0,
        "self_link": F.col("self_links") > 0,
        "cycle": F.col("cyclic") > 0,
        "supersedes_unknown": F.col("unknown") > 0,
        "subject_changed": F.col("moved") > 0,
    }
    out = out.withColumn("violations", F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()])))
    return out.select("subject", F.when(F.size("violations") == 0, F.col("terminal")).alias("effective_review_id"), "violations")
