"""SQL for the clustering and the manifest, put together level by level and round by round."""

from __future__ import annotations

#: Levels of trees that the SQL covers: 8 ** 8 rows of a language, 8 ** 4 languages.
LEAF_LEVELS, TOP_LEVELS = 8, 4


def clustering(clusters: int, rounds: int, dimension: int, scale: int, salt: str) -> str:
    """Rounds of assigning every vector to its nearest centroid, then moving the centroids."""
    assign = """a{i} as materialized (
            select row, min(struct_pack(d := list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := c.c)) as best
            from v, c{i} c group by row)"""
    move = """c{n} as materialized (
            select c.c, coalesce(m.v, c.v) as v from c{i} c left join (
                select c, list(cast((s - ((s % n + n) % n)) // n as bigint) order by i) as v from (
                    select c, i, sum(x) as s, count(*) as n
                    from (select best.c as c, unnest(v) as x, generate_subscripts(v, 1) as i from a{i} join v using (row))
                    group by c, i)
                group by c) m on m.c = c.c)"""
    steps = [assign.format(i=0)]
    for i in range(rounds):
        steps += [move.format(i=i, n=i + 1), assign.format(i=i + 1)]
    joined = ",\n        ".join(steps)
    return f"""
        with v as materialized (
            select row_number() over () as row, vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v
            from embeddings
            where len(embedding) = {dimension} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dimension}
        ), c0 as materialized (
            select row_number() over (order by h nulls last, v) - 1 as c, v from (select v, sha256('{salt}' || vec_id) as h from v)
            qualify row_number() over (order by h nulls last, v) <= {clusters}
        ),
        {joined}
        select vec_id, cast(best.c as integer) as cluster, cast(best.d as bigint) as distance,
            cast(sum(best.d) over (partition by best.c) as bigint) as cluster_inertia, cast(sum(best.d) over () as bigint) as inertia,
            sha256(array_to_string(c.v, ',')) as centroid_sha256
        from a{rounds} join v using (row) join c{rounds} c on c.c = best.c"""


def _field(value: str) -> str:
    text = f"cast({value} as varchar)"
    return f"case when {value} is null then '-' else cast(strlen({text}) as varchar) || ':' || {text} end"


def _levels(name: str, first: str, depth: int, key: str) -> str:
    """Nodes of all levels, each with the digests of its run before and after it."""
    parts = []
    for k in range(depth + 1):
        source = first
        if k:
            source = f"""select {key}, pos // 8 as pos, (any_value(n) + 7) // 8 as n,
                case when any_value(n) > 1 then sha256(string_agg(digest, '' order by pos)) else min(digest) end as digest
                from {name}{k - 1} group by {key}, pos // 8"""
        parts.append(f"""{name}{k} as materialized (
            select *, coalesce(string_agg(digest, '') over (run rows between unbounded preceding and 1 preceding), '') as earlier,
                coalesce(string_agg(digest, '') over (run rows between 1 following and unbounded following), '') as later
            from ({source}) window run as (partition by {key}, pos // 8 order by pos))""")
    return ",\n        ".join(parts)


def _climb(rows: str, columns: str, name: str, depth: int, key: str) -> str:
    """``rows`` (key, pos, proof, folded) taken up level by level."""
    for k in range(depth):
        rows = f"""select {columns}, r.{key}, r.pos // 8 as pos, r.proof || t.earlier || t.later as proof,
            case when t.n > 1 then sha256(t.earlier || r.folded || t.later) else r.folded end as folded
            from ({rows}) r join {name}{k} t on t.{key} = r.{key} and t.pos = r.pos"""
    return rows


def tree() -> str:
    """The manifest: leaves, roots, proofs, and what they prove of rows with changed text."""
    fields = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    columns = "r.row, r.doc_id, r.leaf"
    start = "select row, doc_id, digest as leaf, tree, pos, '' as proof, case when tampered then found else digest end as folded from leaves"
    climbed = _climb(start, columns, "t", LEAF_LEVELS, "tree")
    onward = f"select r.row, r.doc_id, r.leaf, r.tree, '' as whole, s.pos, r.proof, r.folded from ({climbed}) r join s0 s on s.tree = r.tree"
    climbed = _climb(onward, columns + ", r.tree", "s", TOP_LEVELS, "whole")
    return f"""
        with crc as (
            select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
                lambda c, j: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
        ), leaves as materialized (
            select *, row_number() over (partition by tree order by doc_id nulls first, digest) - 1 as pos,
                row_number() over () as row, count(*) over (partition by tree) as n
            from (
                select doc_id, case when lang is null then '0' else '1' || lang end as tree,
                    sha256({fields} || {_field('text')}) as digest, sha256({fields} || {_field(lower)}) as found,
                    coalesce(xor(list_reduce(list_concat([4294967295], list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
                        lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)), 4294967295) % 3 = 0, false) as tampered
                from documents, crc)
        ),
        {_levels("t", "select tree, pos, digest, n from leaves", LEAF_LEVELS, "tree")},
        {_levels("s", f"select '' as whole, tree, row_number() over (order by tree) - 1 as pos, digest, count(*) over () as n from t{LEAF_LEVELS}", TOP_LEVELS, "whole")}
        select r.doc_id, r.leaf, b.digest as subroot, w.digest as root, sha256(r.proof) as proof_sha256, r.folded as folded_root, r.folded = w.digest as verified
        from ({climbed}) r join t{LEAF_LEVELS} b on b.tree = r.tree cross join s{TOP_LEVELS} w"""
