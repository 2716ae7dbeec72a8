"""A Merkle manifest of a table: a content-addressed DAG of three-way nodes, and proofs by descent from its root.

Leaves. A row's leaf is the digest of some of its fields, each ``-`` if null, else its length in bytes, a colon and the
value. Per group (a document's source) the leaves stand in key order; while several nodes remain, every three neighbours
become one node, the digest of their digests. What remains are the subroots, which, in the order of their groups (null
first, then bytewise), become the root the same way.

Store. Records map a node's digest to its children's digests. They are kept in packs: the records of five levels below
one node (121 at most), under that node's digest, so that a descent fetches five levels at a time. A group's deeper
packs hang below its upper ones; equal subtrees have one pack.

Descent. The digits to base three of a leaf's place, most significant first, lead from the root down: at each
node the digit selects a child, and what stands before and behind it is collected as a segment of the path. Requests
whose paths share a pack walk down to it once, as one row, and part there; so a request needs no joins
at the root, where all of them would meet on one digest. Segments reversed lead from leaf to root: their
texts are the proof, and folding a leaf with them gives a root to compare.

Spark. Places come from a running count over ranges of (group, key), so a hot group isn't one task. Building and
descent are a group-by and equi-joins per five levels, on at most 243 rows a group, in built-in functions.

Defined results: null fields, keys and groups are values of their own; rows of one key are ordered by their
leaves, and equal rows are interchangeable (each has a proof); texts of any length are hashed whole; an empty table has
no root and no rows; columns other than the named ones play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import saved, table
from gavel.operators.running import running_frame

#: Children of a node, and levels in a pack.
WAYS, LEVELS = 3, 5
PACK = WAYS ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SEGMENT = "array<struct<before: string, behind: string>>"


def field(c: Column) -> Column:
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def _depth(n: Column) -> Column:
    """Levels above n leaves until one node remains."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(39)), F.lit(0), lambda d, k: F.when(F.pow(F.lit(WAYS), k - 1).cast("long") < n, k).otherwise(d))


def _div(a: Column, b) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def _digit(at: Column, level: Column) -> Column:
    return F.pmod(_div(at, F.pow(F.lit(WAYS), level).cast("long")), F.lit(WAYS)).cast("int")


@dataclass
class Tree:
    """Trees over the leaves of some groups: ``trees`` (group, n, depth, digest), a row each, and their ``packs``
    (digest, records) by level."""

    trees: DataFrame
    packs: list[DataFrame]

    def records(self) -> DataFrame:
        """(digest, children) of every different inner node."""
        every = self.packs[0] if self.packs else None
        for p in self.packs[1:]:
            every = every.unionByName(p)
        if every is None:
            return self.trees.select("digest", F.array("digest").alias("children")).where("false")
        return every.select(F.explode("records").alias("digest", "children")).distinct()


def _runs(nodes: Column) -> Column:
    """Every three neighbours of an array, the last run with what is left."""
    return F.transform(F.sequence(F.lit(0), _div(F.size(nodes) - 1, WAYS).cast("int")), lambda i: F.slice(nodes, i * WAYS + 1, F.lit(WAYS)))


def _built(groups: DataFrame) -> DataFrame:
    """(group, at, digest, records) of packs from (group, at, digests, height): the nodes of ``height`` levels."""
    packs = groups.withColumn("a0", F.col("digests"))
    for k in range(1, LEVELS + 1):
        below, up = F.col(f"a{k - 1}"), F.lit(k) <= F.col("height")
        packs = packs.withColumn(f"c{k}", F.when(up, _runs(below)))
        packs = packs.withColumn(f"a{k}", F.when(up, F.transform(F.col(f"c{k}"), lambda run: F.sha2(F.array_join(run, ""), 256))).otherwise(below))
    none = F.array().cast("array<struct<digest: string, children: array<string>>>")
    entries = [F.coalesce(F.when(F.lit(k) <= F.col("height"), F.arrays_zip(F.col(f"a{k}").alias("digest"), F.col(f"c{k}").alias("children"))), none)
               for k in range(1, LEVELS + 1)]
    return packs.select("group", "at", F.col(f"a{LEVELS}")[0].alias("digest"), F.map_from_entries(F.array_distinct(F.concat(*entries))).alias("records"))


def grow(leaves: DataFrame) -> Tree:
    """The trees of (group, at, digest), whose ``at`` counts each group's leaves from 0."""
    sizes = saved(leaves.groupBy("group").agg(F.count("*").alias("n")).withColumn("depth", _depth(F.col("n"))))
    deepest = sizes.agg(F.max("depth")).first()[0] or 0
    nodes, packs, roots = leaves, [], leaves.join(sizes.where("depth = 0"), _same("group", leaves, sizes)).select(leaves["group"], "digest")
    for level in range(-(-deepest // LEVELS)):
        # The nodes of a group stand LEVELS * level above its leaves; groups that have come to one node are done.
        more = sizes.where(F.col("depth") > LEVELS * level).select(F.col("group").alias("of"), F.least(F.col("depth") - LEVELS * level, F.lit(LEVELS)).alias("height"))
        runs = nodes.groupBy("group", _div(F.col("at"), PACK).alias("run")).agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("all"))
        runs = runs.join(more, F.col("group").eqNullSafe(F.col("of")))
        runs = runs.select("group", F.col("run").alias("at"), F.col("all.digest").alias("digests"), "height")
        built = saved(_built(runs))
        packs.append(built.select("digest", "records").dropDuplicates(["digest"]))
        done = sizes.where(_div(F.col("depth") + LEVELS - 1, LEVELS) == level + 1).select(F.col("group").alias("of"))
        nodes = built.select("group", "at", "digest")
        roots = roots.unionByName(nodes.join(done, F.col("group").eqNullSafe(F.col("of"))).select("group", "digest"))
    named = roots.select(F.col("group").alias("of"), "digest")
    return Tree(saved(sizes.join(named, F.col("group").eqNullSafe(F.col("of"))).select("group", "n", "depth", "digest")), packs)


def _same(name: str, left: DataFrame, right: DataFrame) -> Column:
    return left[name].eqNullSafe(right[name])


def descend(tree: Tree, tops: DataFrame, requests: DataFrame) -> DataFrame:
    """Every request (group, at, what: any struct) with the ``digest`` found at its place and its ``path``, segments
    from the top down. ``tops`` (group, path) gives the path that leads to each group's root."""
    roots = tree.trees.join(tops.select(F.col("group").alias("of"), "path"), F.col("group").eqNullSafe(F.col("of")))
    roots = saved(roots.select("group", F.lit(0).cast("long").alias("at"), "digest", "path", "depth"))
    lone = roots.where("depth = 0").select(F.col("group").alias("of"), "digest", "path")
    out = requests.join(lone, F.col("group").eqNullSafe(F.col("of"))).select("group", "at", "what", "digest", "path")
    frontier = None
    for level in reversed(range(len(tree.packs))):
        begin = roots.where(_div(F.col("depth") + LEVELS - 1, LEVELS) == level + 1)
        frontier = begin if frontier is None else frontier.unionByName(begin)
        # What is asked for below each pack: its requests, or the packs on the way to them.
        wanted = requests if level == 0 else requests.select("group", _div(F.col("at"), PACK ** level).alias("at"), F.lit(None).alias("what")).distinct()
        wanted = wanted.groupBy(F.col("group").alias("of"), _div(F.col("at"), PACK).alias("pack")).agg(F.collect_list(F.struct("at", "what")).alias("asked"))
        met = frontier.join(wanted, F.col("group").eqNullSafe(F.col("of")) & (F.col("at") == F.col("pack")))
        met = met.join(tree.packs[level].select(F.col("digest").alias("top"), "records"), F.col("digest") == F.col("top"))
        found = met.select("group", "depth", F.inline(F.transform("asked", lambda r: _walk(r, level))))
        if level:
            frontier = saved(found.select("group", "at", "digest", "path", "depth"))
        else:
            out = out.unionByName(found.select("group", "at", "what", "digest", "path"))
    return out


def _walk(request: Column, level: int) -> Column:
    """One request's way through a pack: the digits of its place select children, the others are collected."""
    height = F.least(F.col("depth") - LEVELS * level, F.lit(LEVELS))

    def step(acc, k):
        children = F.element_at(F.col("records"), acc["digest"])
        digit = _digit(request["at"], k)
        behind = F.array_join(F.slice(children, digit + 2, F.lit(WAYS)), "")
        segment = F.struct(F.array_join(F.slice(children, F.lit(1), digit), "").alias("before"), behind.alias("behind"))
        return F.struct(F.element_at(children, digit + 1).alias("digest"), F.concat(acc["path"], F.array(segment)).alias("path"))
    start = F.struct(F.col("digest").alias("digest"), F.col("path").alias("path"))
    way = F.aggregate(F.sequence(height - 1, F.lit(0), F.lit(-1)), start, step)
    return F.struct(request["at"].alias("at"), request["what"].alias("what"), way["digest"].alias("digest"), way["path"].alias("path"))


def proof(path: Column) -> Column:
    """The siblings along a path from leaf to root."""
    return F.array_join(F.transform(F.reverse(path), lambda s: F.concat(s["before"], s["behind"])), "")


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf gives with a path."""
    return F.aggregate(F.reverse(path), digest, lambda d, s: F.sha2(F.concat(s["before"], d, s["behind"]), 256))


@dataclass
class Manifest:
    """``leaves`` (group, at, leaf, what) of every row, their trees by group, and the tree of the subroots
    (its one group is ''), whose leaves ``places`` (at, of) names."""

    leaves: DataFrame
    groups: Tree
    top: Tree
    places: DataFrame

    def prove(self, requests: DataFrame) -> DataFrame:
        """Requests (group, at, what) with subroot, root, digest and path."""
        start = self.top.trees.select("group", F.array().cast(SEGMENT).alias("path"))
        tops = descend(self.top, start, self.places.select(F.lit("").alias("group"), "at", F.struct("of").alias("what")))
        root = self.top.trees.select(F.col("group").alias("all"), F.col("digest").alias("root"))
        tops = tops.join(root, F.col("group") == F.col("all"))
        tops = saved(tops.select(F.col("what")["of"].alias("group"), "path", F.col("digest").alias("subroot"), "root"))
        found = descend(self.groups, tops.select("group", "path"), requests)
        known = tops.select(F.col("group").alias("of"), "subroot", "root")
        return found.join(known, F.col("group").eqNullSafe(F.col("of"))).drop("of")


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, **also: Column) -> Manifest:
    """The manifest of a table. ``also`` names further columns to keep with each leaf, in ``what``."""
    rows = docs.select(F.col(group).cast("string").alias("group"), F.col(key).alias("key"), leaf(*map(F.col, fields)).alias("leaf"),
                       *[c.alias(name) for name, c in also.items()], F.lit(1).alias("one"))
    ranked = running_frame(rows, ["group"], ["key", "leaf"], "one")
    leaves = saved(ranked.select("group", (F.col("frame_count") - 1).alias("at"), "leaf", F.struct("key", "leaf", *also).alias("what")))
    groups = grow(leaves.select("group", "at", F.col("leaf").alias("digest")))
    subroots = running_frame(groups.trees.select(F.lit("").alias("all"), "group", "digest", F.lit(1).alias("one")), ["all"], ["group"], "one")
    subroots = saved(subroots.select((F.col("frame_count") - 1).alias("at"), F.col("group").alias("of"), "digest"))
    top = grow(subroots.select(F.lit("").alias("group"), "at", "digest"))
    return Manifest(leaves, groups, top, subroots.select("at", "of"))


def verdicts(docs: DataFrame, tampered: Column, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Every row of a table with its leaf, subroot, root, path, the root that its present fields give (``text`` being
    ``tampered``) and whether that is the root."""
    fields = [tampered if c == text else F.col(c) for c in how.get("fields", FIELDS)]
    known = manifest(docs, key, now=leaf(*fields), **how)
    found = known.prove(known.leaves.select("group", "at", "what"))
    found = found.select(F.col("what")["key"].alias(key), F.col("what")["leaf"].alias("leaf"), "subroot", "root", "path",
                         fold(F.col("what")["now"], F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    chosen = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0, F.lit(False))
    tampered = F.when(chosen, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = verdicts(table(spark, sf_dir, "documents"), tampered)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", "verified")


def _oracle_sql(deep: int = 14, wide: int = 8) -> str:
    """The query in DuckDB SQL, level by level without packs or descent: up to 3**deep leaves a source, 3**wide sources."""
    def h(text):
        fields = ["doc_id", "source", "lang", "n_chars", text]
        return "sha256(" + " || ".join(f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields) + ")"
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    crc = (f"list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda r, b: "
           f"list_reduce(CAST([0,0,0,0,0,0,0,0] AS BIGINT[]), lambda x, i: {bit}, xor(r, b)), CAST(4294967295 AS BIGINT))")
    parts = [f"""t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM (
  SELECT doc_id, source, {h('text')} AS leaf, CASE WHEN {crc} & 1 = 1 THEN {h("replace(text, chr(10), '')")} ELSE {h('text')} END AS now FROM documents))""",
             "s0 AS MATERIALIZED (SELECT source AS g, r AS i, leaf AS h, count(*) OVER (PARTITION BY source) AS c FROM t)"]

    def level(to, of):
        up = f"SELECT g, i // 3 AS i, CASE WHEN max(c) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {of} GROUP BY g, i // 3"
        return f"{to} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM ({up}))"

    def climb(to, of, nodes):
        """Each row's place and fold one level further up, and its siblings so far."""
        side = "coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i {} f.r), '')"
        return f"""{to} AS MATERIALIZED (SELECT id, g, r // 3 AS r, CASE WHEN c = 1 THEN fold ELSE sha256(a || fold || b) END AS fold, way || a || b AS way FROM (
  SELECT f.id, f.g, f.r, f.fold, f.way, max(n.c) AS c, {side.format('<')} AS a, {side.format('>')} AS b
  FROM {of} f JOIN {nodes} n ON n.g IS NOT DISTINCT FROM f.g AND n.i // 3 = f.r // 3 GROUP BY ALL))"""
    parts += [level(f"s{k + 1}", f"s{k}") for k in range(deep)]
    parts.append(f"w0 AS MATERIALIZED (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h, count(*) OVER () AS c, g AS of FROM s{deep})")
    parts += [level(f"w{k + 1}", f"w{k}") for k in range(wide)]
    parts.append("f0 AS MATERIALIZED (SELECT row_number() OVER () AS id, source AS g, r, now AS fold, '' AS way, doc_id, leaf FROM t)")
    parts += [climb(f"f{k + 1}", f"f{k}", f"s{k}") for k in range(deep)]
    parts.append(f"e0 AS MATERIALIZED (SELECT f.id, 0 AS g, w.i AS r, f.fold, f.way FROM f{deep} f JOIN w0 w ON w.of IS NOT DISTINCT FROM f.g)")
    parts += [climb(f"e{k + 1}", f"e{k}", f"w{k}") for k in range(wide)]
    return "WITH " + ",\n".join(parts) + f"""
SELECT f.doc_id, f.leaf, w.h AS subroot, r.h AS root, sha256(e.way) AS proof_sha256, e.fold AS folded_root, e.fold = r.h AS verified
FROM f0 f JOIN e{wide} e USING (id) JOIN w0 w ON w.of IS NOT DISTINCT FROM f.g, w{wide} r"""


ORACLE_SQL = _oracle_sql()
