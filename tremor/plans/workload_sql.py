"""SQL for the workload's queries, in the dialect of DuckDB."""

_TIES = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


_PATH = "p_brand || '::' || p_type || '::part_' || lpad(CAST(p_partkey AS VARCHAR), 6, '0')"


def _fnv(path: str) -> str:
    """The 64-bit FNV-1a hash of an ASCII path."""
    return f"""CAST(list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(range(1, strlen({path}) + 1), lambda i: ascii(substr({path}, i, 1))::hugeint)),
        lambda h, b: (xor(h, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint) AS UBIGINT)"""


_GRAPH = f"""
    symbols AS (
        SELECT p_partkey AS id, {_PATH} AS fq_path, p_brand AS crate_name,
            p_size >= 46 AS test, p_size % 2 = 0 AS public, p_brand = 'Brand#5' AS is_foreign, p_size <= 3 AS uses_unsafe, p_type
        FROM part WHERE p_size <> 25),
    following AS (
        SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {_TIES}) AS dst FROM lineitem),
    successions AS (SELECT * FROM following WHERE dst IS NOT NULL AND dst <> l_partkey AND l_returnflag = 'R'),
    plain AS (
        SELECT DISTINCT l_partkey AS src, dst, CASE WHEN l_linestatus = 'O' THEN 'Virtual' ELSE 'Static' END AS kind
        FROM successions WHERE l_partkey IN (SELECT id FROM symbols)),
    edges AS (
        SELECT e.*, d.id IS NULL AS dst_absent, coalesce(d.is_foreign, true) AS dst_boundary, coalesce(s.is_foreign, true) AS src_boundary
        FROM plain e LEFT JOIN symbols d ON d.id = e.dst LEFT JOIN symbols s ON s.id = e.src)"""


_CALLS = f"""calls AS (
    SELECT l_partkey AS src, dst, CASE l_returnflag WHEN 'R' THEN 'Item' WHEN 'A' THEN 'Virtual' ELSE 'Unresolved' END AS callee_kind
    FROM (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {_TIES}) AS dst FROM lineitem) WHERE dst IS NOT NULL)"""
_FORWARD = "first AS (SELECT src AS id FROM edges WHERE NOT src_boundary GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"
_BACKWARD = "first AS (SELECT dst AS id FROM edges WHERE NOT dst_boundary GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"
_REACH_FORWARD = """reach AS (
        SELECT dst AS id FROM edges WHERE src = (SELECT id FROM first) AND NOT dst_boundary
        UNION SELECT e.dst FROM reach r JOIN edges e ON e.src = r.id WHERE NOT e.dst_boundary),
    scanned AS (SELECT * FROM edges WHERE src IN (SELECT id FROM reach UNION SELECT id FROM first))"""
_REACH_BACKWARD = """reach AS (
        SELECT src AS id FROM edges WHERE dst = (SELECT id FROM first) AND NOT src_boundary
        UNION SELECT e.src FROM reach r JOIN edges e ON e.dst = r.id WHERE NOT e.src_boundary),
    scanned AS (SELECT * FROM edges WHERE dst IN (SELECT id FROM reach UNION SELECT id FROM first))"""
_FLAGS = """flags AS (
        SELECT coalesce(bool_or(kind = 'Virtual'), false) AS over_approximated,
            count(DISTINCT CASE WHEN kind = 'Virtual' THEN dst END) AS implementor_count,
            coalesce(bool_or(dst_boundary), false) AS boundary_applies FROM scanned)"""
_FACTS = "total, truncated, over_approximated, implementor_count, boundary_applies"


def _limited(found: str, limit: int) -> str:
    """found: SELECT of (list, id); rows numbered within their list, the totals over all."""
    return f"""found AS ({found}),
    facts AS (
        SELECT (SELECT count(*) FROM found) AS total,
            coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM found GROUP BY list)), 0) > {limit} AS truncated, * FROM flags),
    ranked AS (SELECT list, s.id, fq_path, crate_name, row_number() OVER (PARTITION BY list ORDER BY fq_path, s.id) AS r FROM found f JOIN symbols s ON s.id = f.id)
    SELECT list, id, fq_path, crate_name, {_FACTS} FROM facts LEFT JOIN (SELECT * FROM ranked WHERE r <= {limit}) ON true"""


def _query(start: str, reach: str, found: str, limit: int = 200) -> str:
    return f"WITH RECURSIVE {_GRAPH}, {start}, {reach}, {_FLAGS}, {_limited(found, limit)}"


_NEIGHBOURS = "scanned AS (SELECT * FROM edges WHERE dst = (SELECT id FROM first) UNION ALL SELECT * FROM edges WHERE src = (SELECT id FROM first))"
_DIRECT = """SELECT 'callers' AS list, e.src AS id FROM edges e JOIN symbols s ON s.id = e.src WHERE e.dst = (SELECT id FROM first)
    UNION ALL SELECT 'callees', e.dst FROM edges e JOIN symbols s ON s.id = e.dst WHERE e.src = (SELECT id FROM first)"""
_RINGS = f"""WITH RECURSIVE {_GRAPH}, {_FORWARD},
    steps AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
    walk AS (
        SELECT id, 0 AS ring FROM first
        UNION SELECT st.b, w.ring + 1 FROM walk w JOIN symbols s ON s.id = w.id AND NOT s.is_foreign JOIN steps st ON st.a = w.id JOIN symbols t ON t.id = st.b WHERE w.ring < 2),
    nodes AS (SELECT id, min(ring) AS ring FROM walk GROUP BY id),
    kept AS (
        SELECT * FROM (
            SELECT n.id, CAST(ring AS INTEGER) AS ring, fq_path, is_foreign AS "foreign", row_number() OVER (ORDER BY ring, fq_path, n.id) - 1 AS n
            FROM nodes n JOIN symbols s ON s.id = n.id) WHERE n < 60)"""
_DRAWN = """,
    lines AS (
        SELECT e.*, k.n AS from_n, k.fq_path AS from_path, t.n AS to_n, coalesce(s.fq_path, '') AS to_path, s.fq_path AS to_name,
            row_number() OVER (ORDER BY k.fq_path, e.src, coalesce(s.fq_path, ''), e.dst, CASE WHEN e.kind = 'Virtual' THEN 1 ELSE 0 END) AS place
        FROM edges e JOIN kept k ON k.id = e.src LEFT JOIN kept t ON t.id = e.dst LEFT JOIN symbols s ON s.id = e.dst
        WHERE t.id IS NOT NULL OR e.dst_boundary),
    outside AS (SELECT dst, row_number() OVER (ORDER BY min(place)) - 1 AS b FROM lines WHERE to_n IS NULL GROUP BY dst),
    drawn AS (
        SELECT l.*, o.b, 'n' || from_n || CASE WHEN dst_boundary THEN ' ==>|boundary| ' WHEN kind = 'Virtual' THEN ' -.->|dyn| ' ELSE ' --> ' END
            || coalesce('n' || to_n, 'b' || o.b) AS line,
            replace(replace(replace(replace(coalesce(to_name, 'external'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS label
        FROM lines l LEFT JOIN outside o ON o.dst = l.dst)"""
_YEARS = f"""WITH {_GRAPH},
    years AS (SELECT DISTINCT l_partkey AS id, CAST(year(l_shipdate) AS VARCHAR) AS fragment FROM successions),
    seen AS (
        SELECT s.id, fq_path, fragment, crate_name || '@' || fragment AS crate_name, test AND CAST(fragment AS INTEGER) % 2 = 1 AS test,
            public AND CAST(fragment AS INTEGER) % 2 <> 1 AS public, uses_unsafe FROM symbols s JOIN years y ON y.id = s.id)"""

ORACLE_SQL = {
    "c1_resolve_symbol": f"""WITH {_GRAPH}, flags AS (SELECT false AS over_approximated, CAST(0 AS BIGINT) AS implementor_count, false AS boundary_applies),
        {_limited("SELECT 'symbols' AS list, id FROM symbols WHERE contains(lower(fq_path), lower('PROMO::Part_0000'))", 25)}""",
    "c2_direct_calls": _query(_BACKWARD, _NEIGHBOURS, _DIRECT),
    "c2_parallel_edges": _query(_BACKWARD, _NEIGHBOURS, _DIRECT, 30),
    "c3_reachability_forward": _query(_FORWARD, _REACH_FORWARD, "SELECT 'symbols' AS list, id FROM reach", 100_000),
    "c3_reachability_backward": _query(_BACKWARD, _REACH_BACKWARD, "SELECT 'symbols' AS list, id FROM reach", 50),
    "c3_reachability_levels": _query(_FORWARD, _REACH_FORWARD, "SELECT 'symbols' AS list, id FROM reach", 100_000),
    "c4_call_paths": f"""WITH RECURSIVE {_GRAPH}, {_FORWARD},
        target AS (
            SELECT min(q.dst) AS id FROM edges p JOIN edges q ON q.src = p.dst
            WHERE p.src = (SELECT id FROM first) AND NOT p.dst_absent AND NOT q.dst_absent AND q.dst <> (SELECT id FROM first)),
        steps AS (SELECT e.*, {{'f': coalesce(s.fq_path, ''), 'i': e.dst, 'k': CASE WHEN kind = 'Virtual' THEN 1 ELSE 0 END}} AS step FROM edges e LEFT JOIN symbols s ON s.id = e.dst),
        tried AS (
            SELECT [f.id] AS path, [s.step] AS key, s.dst, s.kind, s.dst_boundary, s.dst_absent, 1 AS depth FROM first f JOIN steps s ON s.src = f.id
            UNION ALL
            SELECT list_append(t.path, t.dst), list_append(t.key, s.step), s.dst, s.kind, s.dst_boundary, s.dst_absent, t.depth + 1
            FROM tried t JOIN steps s ON s.src = t.dst
            WHERE t.depth < 4 AND NOT t.dst_absent AND NOT list_contains(t.path, t.dst) AND t.dst <> (SELECT id FROM target)),
        arrived AS (
            SELECT key, row_number() OVER (ORDER BY key) AS r FROM tried
            WHERE dst = (SELECT id FROM target) AND NOT list_contains(path, dst)),
        bound AS (SELECT max(key) AS key FROM arrived WHERE r = 41),
        scanned AS (SELECT * FROM tried WHERE (SELECT key FROM bound) IS NULL OR key <= (SELECT key FROM bound)),
        deep AS (
            SELECT count(*) > 0 AS cut FROM tried t JOIN edges e ON e.src = t.dst
            WHERE t.depth = 4 AND NOT t.dst_absent AND NOT list_contains(t.path, t.dst) AND t.dst <> (SELECT id FROM target) AND e.dst <> t.dst),
        {_FLAGS},
        facts AS (SELECT (SELECT count(*) FROM arrived WHERE r <= 40) AS total, (SELECT key IS NOT NULL FROM bound) OR (SELECT cut FROM deep) AS truncated, * FROM flags),
        named AS (SELECT s.fq_path || ' > ' || array_to_string(list_transform(key, lambda x: x.f), ' > ') AS path FROM arrived, first JOIN symbols s ON s.id = first.id WHERE r <= 40)
        SELECT path, {_FACTS} FROM facts LEFT JOIN named ON true""",
    "c5_affected_tests": _query(_BACKWARD, _REACH_BACKWARD, "SELECT 'tests' AS list, r.id FROM reach r JOIN symbols s ON s.id = r.id WHERE s.test"),
    "c6_reachable_unsafe": _query(_FORWARD, _REACH_FORWARD, "SELECT 'symbols' AS list, r.id FROM reach r JOIN symbols s ON s.id = r.id WHERE s.uses_unsafe"),
    "c7_impact": _query(_BACKWARD, _REACH_BACKWARD, """SELECT 'direct_callers' AS list, e.src AS id FROM edges e WHERE e.dst = (SELECT id FROM first)
        UNION ALL SELECT 'affected_tests', r.id FROM reach r JOIN symbols s ON s.id = r.id WHERE s.test"""),
    "c8_neighborhood_nodes": f"{_RINGS} SELECT * FROM kept",
    "c8_neighborhood_edges": f"{_RINGS}{_DRAWN} SELECT line, label, to_n IS NULL AS synthetic FROM drawn",
    "c8_neighborhood_diagram": f"""{_RINGS}{_DRAWN},
        text AS (
            SELECT 1 AS part, n AS place, 'n' || n || '["' || replace(replace(replace(replace(fq_path, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '"]'
                || CASE WHEN ring = 0 THEN ':::focus' WHEN "foreign" THEN ':::boundary' ELSE '' END AS line FROM kept
            UNION ALL SELECT DISTINCT 2, b, 'b' || b || '["' || label || '"]:::boundary' FROM drawn WHERE b IS NOT NULL
            UNION ALL SELECT 3, 0, 'trunc_note["+' || (count(*) - 60) || ' more not shown (total ' || count(*) || ')"]:::trunc' FROM nodes HAVING count(*) > 60
            UNION ALL SELECT 4, place, line FROM drawn
            UNION ALL SELECT 5, 0, 'classDef focus fill:#ffd54f,stroke:#333,stroke-width:2px;'
            UNION ALL SELECT 5, 1, 'classDef boundary fill:#eeeeee,stroke:#999,stroke-dasharray:4 3;'
            UNION ALL SELECT 5, 2, 'classDef trunc fill:#ffffff,stroke:#c62828,stroke-dasharray:2 2;')
        SELECT 'flowchart TD' || chr(10) || (SELECT string_agg('    ' || line || chr(10), '' ORDER BY part, place) FROM text) AS text,
            (SELECT count(*) FROM nodes) AS total, (SELECT count(*) FROM nodes) > 60 AS truncated,
            coalesce((SELECT bool_or(kind = 'Virtual') FROM drawn), false) AS over_approximated,
            (SELECT count(DISTINCT dst) FROM edges WHERE kind = 'Virtual' AND src IN (SELECT id FROM kept)) AS implementor_count,
            coalesce((SELECT bool_or(dst_boundary) FROM drawn), false) AS boundary_applies""",
    "walk_flags": f"WITH {_GRAPH}, scanned AS (SELECT * FROM edges), {_FLAGS} SELECT * FROM flags",
    "boundary_targets": f"WITH {_GRAPH} SELECT dst, dst_absent, count(*) AS n_edges FROM edges WHERE dst_boundary GROUP BY 1, 2",
    "merge_symbols": f"""{_YEARS} SELECT id, fq_path, arg_min(crate_name, fragment) AS crate_name, bool_or(test) AS test, bool_or(public) AS public, bool_or(uses_unsafe) AS uses_unsafe
        FROM seen GROUP BY id, fq_path""",
    "merge_collisions": f"{_YEARS} SELECT id % 97 AS id, count(DISTINCT fq_path) AS n_paths, min(fq_path) AS first_path FROM seen GROUP BY 1 HAVING count(DISTINCT fq_path) > 1",
    "merge_dispatch_edges": f"""WITH {_GRAPH} SELECT DISTINCT a.id AS src, b.id AS target, 'Virtual' AS kind
        FROM symbols a JOIN symbols b ON a.p_type = b.p_type AND a.id % 40 = b.id % 40""",
    "merge_fragment_edges": f"""WITH {_GRAPH},
        hashed AS (SELECT p_partkey AS id, CAST({_fnv("path")} AS VARCHAR) AS h FROM (SELECT p_partkey, {_PATH} AS path FROM part)),
        every AS (
            SELECT l_partkey AS src, dst, CASE WHEN l_linestatus = 'O' THEN 'Virtual' ELSE 'Static' END AS kind FROM successions
            UNION SELECT a.id, b.id, 'Virtual' FROM symbols a JOIN symbols b ON a.p_type = b.p_type AND a.id % 40 = b.id % 40)
        SELECT s.h AS src, d.h AS dst, kind FROM every e JOIN hashed s ON s.id = e.src JOIN hashed d ON d.id = e.dst
        WHERE e.src IN (SELECT id FROM symbols) AND e.src IN (SELECT l_partkey FROM successions)""",
    "merge_known_edges": f"WITH {_GRAPH} SELECT src, dst, kind FROM edges",
    "symbol_ids": f"""WITH {_GRAPH} SELECT fq_path, crate_name AS crate, printf('%016x', {_fnv("fq_path")}) AS hex FROM symbols""",
    "diverged_documents": """WITH docs AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS path, text FROM documents),
        recorded AS (SELECT path, md5(text) AS was FROM docs WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'benchmark/' || item_id, md5(text) FROM benchmark),
        present AS (SELECT path, md5(replace(text, chr(10), ' ')) AS now FROM docs)
        SELECT coalesce(r.path, c.path) AS path FROM recorded r FULL OUTER JOIN present c ON r.path = c.path WHERE was IS DISTINCT FROM now""",
    "facts_static_edges": f"WITH {_CALLS} SELECT DISTINCT src, dst, 'Static' AS kind FROM calls WHERE callee_kind = 'Item' AND src <> dst",
    "facts_dyn_calls": f"WITH {_CALLS} SELECT DISTINCT src AS owner, p_brand AS trait_path, 'm' || p_size AS method FROM calls JOIN part ON p_partkey = dst WHERE callee_kind <> 'Item' AND p_type <> 'SMALL'",
    "facts_implementors": f"""SELECT DISTINCT p_brand AS trait_path, 'm' || p_size AS method, {_PATH} || CASE WHEN p_type = 'LARGE' THEN '' ELSE '::<>' END AS fq_path, p_type = 'LARGE' AS "generic"
        FROM part WHERE p_type <> 'SMALL' AND (p_type = 'LARGE' OR p_size <= 40)""",
    "facts_roots": f"SELECT p_partkey AS id, {_PATH} AS fq_path FROM part WHERE p_brand <> 'Brand#5' AND p_type NOT IN ('SMALL', 'LARGE')",
    "facts_worklist": f"""WITH RECURSIVE {_CALLS}, walk AS (
            SELECT p_partkey AS id FROM part WHERE p_brand <> 'Brand#5' AND p_type NOT IN ('SMALL', 'LARGE')
            UNION SELECT dst FROM walk JOIN calls ON src = id JOIN part ON p_partkey = dst WHERE callee_kind = 'Item' AND src <> dst AND p_brand <> 'Brand#5')
        SELECT id FROM walk""",
    "facts_marked_tests": f"WITH {_GRAPH} SELECT id, fq_path, p_size % 10 IN (6, 7) AS test, public FROM symbols JOIN part ON p_partkey = id",
    "facts_unsafe_owners": f"""WITH {_CALLS} SELECT p_partkey AS id, p_size <= 3 OR p_partkey IN (SELECT src FROM calls JOIN part ON p_partkey = dst WHERE p_size <= 3) AS uses_unsafe FROM part""",
    "facts_folded_edges": f"""WITH RECURSIVE {_GRAPH},
        parents AS (SELECT p_partkey AS child, p_partkey - 1 AS parent FROM part WHERE p_type = 'PROMO' AND p_partkey > 1),
        up AS (SELECT child, parent FROM parents UNION ALL SELECT u.child, p.parent FROM up u JOIN parents p ON p.child = u.parent),
        owners AS (SELECT child, parent FROM up WHERE parent NOT IN (SELECT child FROM parents))
        SELECT DISTINCT coalesce(parent, src) AS src, dst, kind FROM plain LEFT JOIN owners ON child = src""",
    "facts_compile_units": """SELECT 'unit_' || p_partkey AS crate_name, CASE WHEN p_size % 2 = 0 THEN 'lib' ELSE 'bin' END AS crate_type, p_brand || '-' || p_type AS toolchain
        FROM part WHERE p_brand <> 'Brand#5' AND p_type <> 'LARGE' AND p_size > 5 AND p_size <> 7 AND p_size < 48""",
}
