"""DuckDB SQL with the results of kmerloom.plans.queries."""

from __future__ import annotations

from .queries import AS_DNA, HEX, K, LOOKUPS, MIN_OBS, SOLID


def rc(s: str) -> str:
    return f"reverse(translate({s}, 'ACGT', 'TGCA'))"


def rc_exts(e: str) -> str:
    moves = [(1, "<< 7"), (2, "<< 5"), (4, "<< 3"), (8, "<< 1"), (16, ">> 1"), (32, ">> 3"), (64, ">> 5"), (128, ">> 7")]
    return "(" + " | ".join(f"(({e} & {m}) {by})" for m, by in moves) + ")"


def code(base: str) -> str:
    return f"(instr('ACGT', {base}) - 1)"


def ext_bit(base: str, right: str) -> str:
    return f"(1 << CAST({code(base)} + CASE WHEN {right} THEN 4 ELSE 0 END AS INTEGER))"


def rank(s: str, k: int) -> str:
    return "(" + " + ".join(f"{code(f'substr({s}, {i + 1}, 1)')} * {4 ** (k - 1 - i)}" for i in range(k)) + ")"


def unrank(x: str, k: int) -> str:
    return "concat(" + ", ".join(f"substr('ACGT', CAST(({x} // {4 ** (k - 1 - i)}) % 4 AS INTEGER) + 1, 1)" for i in range(k)) + ")"


DOC = "doc AS (SELECT doc_id AS seq_id, translate(regexp_replace(text, '[^ACGTacgt]', '', 'g'), 'acgt', 'ACGT') AS seq, lang AS label FROM documents)"
KEY = f"key AS (SELECT o_orderkey AS id, translate(md5(CAST(o_orderkey AS VARCHAR)), '{HEX}', '{AS_DNA}') AS seq, translate(md5(CAST(o_orderkey AS VARCHAR) || 'b'), '{HEX}', '{AS_DNA}') AS other FROM orders)"


def observations(k: int, *, source: str = "doc", stranded: bool = False) -> str:
    """CTEs ending in obs(label, kmer, exts)."""
    raw = f"""raw AS (
      SELECT label, substr(seq, i, {k}) AS kmer,
             CASE WHEN i > 1 THEN {ext_bit('substr(seq, i - 1, 1)', 'false')} ELSE 0 END
           | CASE WHEN i + {k} <= length(seq) THEN {ext_bit(f'substr(seq, i + {k}, 1)', 'true')} ELSE 0 END AS exts
      FROM (SELECT label, seq, CAST(unnest(range(1, length(seq) - {k} + 2)) AS INTEGER) AS i FROM {source} WHERE length(seq) >= {k}))"""
    if stranded:
        return raw + ", obs AS MATERIALIZED (SELECT * FROM raw)"
    return raw + f""", obs AS MATERIALIZED (
      SELECT label, least(kmer, {rc('kmer')}) AS kmer, CASE WHEN kmer >= {rc('kmer')} THEN {rc_exts('exts')} ELSE exts END AS exts FROM raw)"""


def counted(k: int, min_obs: int, *, source: str = "doc", stranded: bool = False, colors: bool = False) -> str:
    """CTEs ending in km(kmer, exts, n, data)."""
    data = "string_agg(DISTINCT label, ',' ORDER BY label)" if colors else "least(count(*), 65535)"
    return observations(k, source=source, stranded=stranded) + f""", km AS MATERIALIZED (
      SELECT kmer, CAST(bit_or(exts) AS INTEGER) AS exts, count(*) AS n, {data} AS data FROM obs GROUP BY kmer HAVING count(*) >= {min_obs})"""


BITS = "bits AS (SELECT b.base, b.side, CAST(1 << CAST(instr('ACGT', b.base) - 1 + CASE WHEN b.side = 'R' THEN 4 ELSE 0 END AS INTEGER) AS INTEGER) AS bit FROM (SELECT unnest(['A','C','G','T']) AS base, s AS side FROM (SELECT unnest(['L','R']) AS s)) b)"


def targets(table: str) -> str:
    """CTEs ending in tg(kmer, bit, target) of the set bits of a table km-like."""
    step = "CASE WHEN side = 'R' THEN substr(kmer, 2) || base ELSE base || substr(kmer, 1, length(kmer) - 1) END"
    return BITS + f""", steps AS (SELECT kmer, bit, {step} AS step FROM {table}, bits WHERE (exts & bit) <> 0),
      tg AS MATERIALIZED (SELECT kmer, bit, least(step, {rc('step')}) AS target FROM steps)"""


def repaired(table: str, condition: str = "true", joined: str = "km") -> str:
    """kmer, exts of a table, with the bits of tg whose target is in `joined` (a hash join), if condition."""
    return f"SELECT k.kmer, CAST(coalesce(b.e, 0) AS INTEGER) AS exts FROM {table} k LEFT JOIN (SELECT t.kmer, bit_or(t.bit) AS e FROM tg t LEFT JOIN {joined} j ON j.kmer = t.target WHERE {condition} GROUP BY t.kmer) b ON b.kmer = k.kmer"


def unitig_ctes(k: int, *, table: str = "km", equal_data: bool = False, join_data: str = "least(sum(data), 65535)") -> str:
    """CTEs ending in uni(seq, exts, members, data): unbranched paths walked from their ends, and circles
    cut before their least k-mer. A state is a k-mer with + or -."""
    test = "AND u.data IS NOT DISTINCT FROM v.data" if equal_data else ""
    same = f"{rc('seq')} = seq"
    data = "min(data)" if equal_data else join_data
    return f"""side AS (SELECT kmer, exts, data, r AS rgt, CASE WHEN r THEN (exts >> 4) & 15 ELSE exts & 15 END AS nib FROM {table}, (SELECT unnest([false, true]) AS r)),
    one AS (SELECT kmer, data, rgt, substr('ACGT', CASE nib WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 3 ELSE 4 END, 1) AS base FROM side WHERE nib IN (1, 2, 4, 8) AND kmer <> {rc('kmer')}),
    stp AS (SELECT kmer, data, rgt, CASE WHEN rgt THEN substr(kmer, 2) || base ELSE base || substr(kmer, 1, {k - 1}) END AS step FROM one),
    nxt AS (SELECT kmer, data, rgt, least(step, {rc('step')}) AS nk, step >= {rc('step')} AS flip FROM stp),
    lnk AS (SELECT u.kmer || CASE WHEN u.rgt THEN '+' ELSE '-' END AS s, v.kmer || CASE WHEN (NOT u.rgt) <> u.flip THEN '-' ELSE '+' END AS t
            FROM nxt u JOIN side v ON v.kmer = u.nk AND v.rgt = ((NOT u.rgt) <> u.flip)
            WHERE v.nib IN (1, 2, 4, 8) AND v.kmer <> {rc('v.kmer')} AND v.kmer <> u.kmer {test}),
    st AS (SELECT kmer || o AS s FROM {table}, (SELECT unnest(['+', '-']) AS o)),
    walk AS (SELECT s AS start, s AS cur, 0 AS pos FROM st WHERE s NOT IN (SELECT t FROM lnk)
             UNION ALL SELECT w.start, l.t, w.pos + 1 FROM walk w JOIN lnk l ON l.s = w.cur),
    rest AS (SELECT kmer FROM {table} WHERE kmer NOT IN (SELECT substr(cur, 1, {k}) FROM walk)),
    ring AS (SELECT kmer || '+' AS start, kmer || '+' AS cur, 0 AS pos FROM rest
             UNION ALL SELECT w.start, l.t, w.pos + 1 FROM ring w JOIN lnk l ON l.s = w.cur WHERE substr(l.t, 1, {k}) > substr(w.start, 1, {k})),
    full_ AS (SELECT r.start FROM ring r JOIN lnk l ON l.s = r.cur AND l.t = r.start),
    steps_ AS (SELECT * FROM walk UNION ALL SELECT ring.* FROM ring JOIN full_ USING (start)),
    mem AS (SELECT w.start, w.pos, CASE WHEN w.cur LIKE '%+' THEN m.kmer ELSE {rc('m.kmer')} END AS ok, CASE WHEN w.cur LIKE '%+' THEN m.exts ELSE {rc_exts('m.exts')} END AS oe, m.data
            FROM steps_ w JOIN {table} m ON m.kmer = substr(w.cur, 1, {k})),
    spelt AS (SELECT string_agg(CASE WHEN pos = 0 THEN ok ELSE right(ok, 1) END, '' ORDER BY pos) AS seq, (arg_min(oe, pos) & 15) | (arg_max(oe, pos) & 240) AS exts, count(*) AS members, {data} AS data FROM mem GROUP BY start),
    uni AS (SELECT DISTINCT least(seq, {rc('seq')}) AS seq, CASE WHEN {same} THEN least(exts, {rc_exts('exts')}) WHEN {rc('seq')} < seq THEN {rc_exts('exts')} ELSE exts END AS exts, members, data FROM spelt)"""


def graph_ctes(k: int = K, min_obs: int = MIN_OBS) -> str:
    """CTEs ending in nd(node_id, seq, exts, members, data), repaired, and ed(src, src_dir, base, dst, dst_side, rc)."""
    return (
        DOC + ", " + counted(k, min_obs) + ", " + unitig_ctes(k) + ", " + BITS + f""",
    raw_nd AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS node_id, * FROM uni),
    ends AS (SELECT node_id, 'L' AS side, substr(seq, 1, {k}) AS kmer FROM raw_nd UNION ALL SELECT node_id, 'R', right(seq, {k}) FROM raw_nd),
    pr AS (SELECT node_id AS src, side AS src_dir, base, CASE WHEN side = 'R' THEN right(seq, {k - 1}) || base ELSE base || substr(seq, 1, {k - 1}) END AS kmer FROM raw_nd, bits WHERE (exts & bit) <> 0),
    hits AS (SELECT p.src, p.src_dir, p.base, 0 AS try, e.node_id AS dst, e.side AS dst_side FROM pr p JOIN ends e ON e.kmer = p.kmer AND e.side = CASE WHEN p.src_dir = 'R' THEN 'L' ELSE 'R' END
             UNION ALL SELECT p.src, p.src_dir, p.base, 1, e.node_id, e.side FROM pr p JOIN ends e ON e.kmer = {rc('p.kmer')} AND e.side = p.src_dir),
    ed AS (SELECT src, src_dir, base, dst, dst_side, try = 1 AS rc FROM (SELECT *, row_number() OVER (PARTITION BY src, src_dir, base ORDER BY try, dst, dst_side) AS rn FROM hits) WHERE rn = 1),
    fx AS (SELECT src, bit_or(bit) AS e FROM ed JOIN bits ON bits.base = ed.base AND bits.side = ed.src_dir GROUP BY src),
    nd AS (SELECT node_id, seq, CAST(coalesce(e, 0) AS INTEGER) AS exts, members, data FROM raw_nd LEFT JOIN fx ON src = node_id)"""
    )


def stranded_ctes(k: int) -> str:
    """CTEs ending in uni(seq, exts, members, data): unbranched paths of a stranded table km."""
    only = "substr('ACGT', CASE {0} WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 3 ELSE 4 END, 1)".format
    return f"""rgt AS (SELECT kmer AS s, substr(kmer, 2) || {only('(exts >> 4) & 15')} AS t FROM km WHERE ((exts >> 4) & 15) IN (1, 2, 4, 8)),
    lft AS (SELECT kmer AS t, {only('exts & 15')} || substr(kmer, 1, {k - 1}) AS s FROM km WHERE (exts & 15) IN (1, 2, 4, 8)),
    lnk AS MATERIALIZED (SELECT r.s, r.t FROM rgt r JOIN lft l ON l.t = r.t AND l.s = r.s WHERE r.s <> r.t),
    walk AS (SELECT kmer AS start, kmer AS cur, 0 AS pos FROM km LEFT JOIN lnk ON t = kmer WHERE t IS NULL
             UNION ALL SELECT w.start, l.t, w.pos + 1 FROM walk w JOIN lnk l ON l.s = w.cur),
    rest AS (SELECT kmer FROM km LEFT JOIN walk ON cur = kmer WHERE cur IS NULL),
    ring AS (SELECT kmer AS start, kmer AS cur, 0 AS pos FROM rest UNION ALL SELECT w.start, l.t, w.pos + 1 FROM ring w JOIN lnk l ON l.s = w.cur WHERE l.t > w.start),
    full_ AS (SELECT r.start FROM ring r JOIN lnk l ON l.s = r.cur AND l.t = r.start),
    mem AS (SELECT w.start, w.pos, w.cur, m.exts, m.data FROM (SELECT * FROM walk UNION ALL SELECT ring.* FROM ring JOIN full_ USING (start)) w JOIN km m ON m.kmer = w.cur),
    uni AS (SELECT string_agg(CASE WHEN pos = 0 THEN cur ELSE right(cur, 1) END, '' ORDER BY pos) AS seq, (arg_min(exts, pos) & 15) | (arg_max(exts, pos) & 240) AS exts, count(*) AS members, least(sum(data), 65535) AS data FROM mem GROUP BY start)"""


#: The documents' graph without its tips, not yet compressed again: edges ke, nodes kd.
CLEANED = f"""tp AS (SELECT node_id FROM (SELECT node_id, length(seq) AS n, bit_count(CAST(exts & 15 AS INTEGER)) AS nl, bit_count(CAST((exts >> 4) & 15 AS INTEGER)) AS nr FROM nd) WHERE n < {2 * K} AND ((nl = 0 AND nr <= 1) OR (nr = 0 AND nl <= 1))),
    kn AS (SELECT nd.* FROM nd LEFT JOIN tp USING (node_id) WHERE tp.node_id IS NULL),
    ke AS (SELECT ed.* FROM ed JOIN kn a ON a.node_id = ed.src JOIN kn b ON b.node_id = ed.dst),
    kx AS (SELECT src, bit_or(bit) AS e FROM ke JOIN bits ON bits.base = ke.base AND bits.side = ke.src_dir GROUP BY src),
    kd AS (SELECT node_id, seq, CAST(coalesce(e, 0) AS INTEGER) AS exts, data FROM kn LEFT JOIN kx ON src = node_id)"""


def other(side: str) -> str:
    return f"(CASE WHEN {side} = 'L' THEN 'R' ELSE 'L' END)"


def max_path_ctes(k: int) -> str:
    """CTEs ending in mp(pos, node_id, dir)."""
    return graph_ctes(k) + f""",
    sc AS (SELECT node_id, CAST(CASE WHEN (exts & 15) > 0 AND (exts & 240) > 0 THEN length(seq) ELSE 0.5 END AS FLOAT) AS score, data > {SOLID} AS solid FROM nd),
    best AS (SELECT node_id FROM sc ORDER BY score DESC, node_id LIMIT 1),
    ah AS (SELECT src, src_dir, dst, dst_side, score, sum(CAST(solid AS INTEGER)) OVER (PARTITION BY src, src_dir) AS solids, row_number() OVER (PARTITION BY src, src_dir ORDER BY score DESC, base, dst, dst_side) AS rn FROM ed JOIN sc ON sc.node_id = ed.dst),
    go AS MATERIALIZED (SELECT src AS node, {other('src_dir')} AS side, dst, dst_side FROM ah WHERE rn = 1 AND solids <= 1 AND score > 0),
    rt AS (SELECT node_id AS node, 'L' AS side, 0 AS pos, [node_id] AS seen FROM best
           UNION ALL SELECT go.dst, go.dst_side, rt.pos + 1, list_append(rt.seen, go.dst) FROM rt JOIN go ON go.node = rt.node AND go.side = rt.side WHERE NOT list_contains(rt.seen, go.dst)),
    us AS MATERIALIZED (SELECT list(node) AS used FROM rt),
    lf AS (SELECT node_id AS node, 'R' AS side, 0 AS pos, [node_id] AS seen FROM best
           UNION ALL SELECT go.dst, go.dst_side, lf.pos + 1, list_append(lf.seen, go.dst) FROM us, lf JOIN go ON go.node = lf.node AND go.side = lf.side WHERE NOT list_contains(lf.seen, go.dst) AND NOT list_contains(us.used, go.dst)),
    mp AS (SELECT CAST(pos + (SELECT max(pos) FROM lf) AS BIGINT) AS pos, node AS node_id, side AS dir FROM rt UNION ALL SELECT CAST((SELECT max(pos) FROM lf) - pos AS BIGINT), node, {other('side')} FROM lf WHERE pos > 0)"""


def beam_path_ctes(beam: int) -> str:
    """CTEs ending in bm(it, path, score, status, o1), of which the rows of the last `it` count."""
    grown = f"""SELECT list_append(b.path, {{'node_id': st.dst, 'dir': st.dst_side}}), CAST(b.score + st.gain AS FLOAT), CASE WHEN len(list_filter(b.path, lambda x: x.node_id = st.dst)) > 0 THEN 'cycle' WHEN st.goes_on THEN 'active' ELSE 'end' END, b.o1, ascii(st.base)
             FROM bm b JOIN sp st ON st.src = b.path[-1].node_id AND st.src_dir = {other('b.path[-1].dir')} WHERE b.status = 'active'"""
    return graph_ctes() + f""",
    sp AS MATERIALIZED (SELECT e.src, e.src_dir, e.base, e.dst, e.dst_side, CAST(n.data AS FLOAT) AS gain, EXISTS (SELECT 1 FROM ed f WHERE f.src = e.dst AND f.src_dir = {other('e.dst_side')}) AS goes_on FROM ed e JOIN nd n ON n.node_id = e.dst),
    ends0 AS (SELECT *, exts & 15 AS l, exts & 240 AS r FROM nd),
    starts AS (SELECT * FROM ends0 WHERE l = 0 OR r = 0 UNION ALL (SELECT * FROM ends0 WHERE NOT EXISTS (SELECT 1 FROM ends0 WHERE l = 0 OR r = 0) ORDER BY node_id LIMIT 1)),
    bm AS (SELECT 0 AS it, [{{'node_id': node_id, 'dir': CASE WHEN l > 0 AND r = 0 THEN 'R' ELSE 'L' END}}] AS path, CAST(data AS FLOAT) AS score, CASE WHEN l = 0 AND r = 0 THEN 'end' ELSE 'active' END AS status, CAST(node_id AS BIGINT) AS o1 FROM starts
           UNION ALL
           SELECT it, path, score, status, rn FROM (
             SELECT (SELECT max(it) FROM bm) + 1 AS it, *, row_number() OVER (ORDER BY score DESC, o1, o2) AS rn FROM (
               SELECT path, score, status, o1, 0 AS o2 FROM bm WHERE status <> 'active' UNION ALL {grown}) WHERE EXISTS (SELECT 1 FROM bm WHERE status = 'active')) WHERE rn <= {beam})"""


def msp_segment_sql(k: int, p: int, *, doc: str = DOC, score: str | None = None) -> str:
    """The segments of `doc`, p-mers m scored by a string: where a walk goes from a p-mer depends on that p-mer alone. It is left for the
    first lesser one of the k - p that follow; else, once out of the window, for the last least of the next."""
    w = k - p + 1
    score = score or f"least(m, {rc('m')})"
    return f"""WITH RECURSIVE {doc}, long_ AS (SELECT * FROM doc WHERE length(seq) >= {k}),
    pm AS (SELECT seq_id, CAST(i - 1 AS INTEGER) AS ps, length(seq) AS n, substr(seq, CAST(i AS INTEGER), {p}) AS m FROM (SELECT seq_id, seq, unnest(range(1, length(seq) - {p} + 2)) AS i FROM long_)),
    sc AS (SELECT seq_id, ps, n, {score} AS s FROM pm),
    ahead AS (SELECT seq_id, ps, n, s, list(s) OVER (PARTITION BY seq_id ORDER BY ps ROWS BETWEEN 1 FOLLOWING AND {w} FOLLOWING) AS l FROM sc),
    look AS (SELECT seq_id, ps, n, list_position(list_transform(l[1:{w - 1}], lambda x: x < s), true) AS less, {w} + 1 - list_position(list_reverse(l), list_min(l)) AS last_least, len(l) AS have FROM ahead),
    nxt AS MATERIALIZED (SELECT seq_id, ps, CASE WHEN less > 0 THEN ps + less WHEN have = {w} THEN ps + last_least END AS too, CASE WHEN less > 0 THEN ps + less - {w - 1} WHEN have = {w} THEN ps + 1 END AS f FROM look WHERE less > 0 OR have = {w}),
    open_ AS (SELECT seq_id, arg_min(ps, (s, -ps)) AS ps FROM sc WHERE ps < {w} GROUP BY seq_id),
    walk AS (SELECT seq_id, 0 AS seg_no, 0 AS start, ps FROM open_
             UNION ALL SELECT w.seq_id, w.seg_no + 1, x.f, x.too FROM walk w JOIN nxt x ON x.seq_id = w.seq_id AND x.ps = w.ps),
    seg AS (SELECT seq_id, seg_no, start, ps, lead(start) OVER (PARTITION BY seq_id ORDER BY seg_no) + {k - 1} AS nx FROM walk),
    cut AS (SELECT d.seq_id, seg_no, ps, start, coalesce(nx, length(d.seq)) - start AS len, d.seq, substr(d.seq, ps + 1, {p}) AS m FROM seg JOIN doc d USING (seq_id))
    SELECT seq_id, CAST(seg_no AS INTEGER) AS seg_no, CAST({rank(f"least(m, {rc('m')})", p)} AS BIGINT) AS bucket, m AS minimizer, CAST(ps AS INTEGER) AS minimizer_pos, CAST(start AS INTEGER) AS start, CAST(len AS INTEGER) AS len,
           CAST(CASE WHEN start > 0 THEN {ext_bit('substr(seq, start, 1)', 'false')} ELSE 0 END | CASE WHEN start + len < length(seq) THEN {ext_bit('substr(seq, start + len + 1, 1)', 'true')} ELSE 0 END AS INTEGER) AS exts, substr(seq, start + 1, len) AS seq FROM cut"""


UNI = "SELECT seq, CAST(length(seq) AS BIGINT) AS len, CAST(exts AS INTEGER) AS exts, CAST(members AS BIGINT) AS members, CAST(data AS BIGINT) AS data FROM uni"


def _shard(kmer: str) -> str:
    return f"(substr({kmer}, 1, 1) || translate(substr({kmer}, 2, 1), 'CT', 'AG'))"


def _rank_dna(k: int) -> str:
    return rank("seq", k)


def oracle_sql() -> dict[str, str]:
    key, doc = f"WITH {KEY} ", f"WITH {DOC}"
    km = f"WITH {DOC}, {counted(K, MIN_OBS)}"
    graph = f"WITH RECURSIVE {graph_ctes()} "
    bits = lambda expr: f"length(replace(bin(CAST({expr} AS BIGINT)), '0', ''))"
    nib = lambda e, right: f"(({e} >> 4) & 15)" if right else f"({e} & 15)"
    letters = lambda n: "concat(" + ", ".join(f"CASE WHEN ({n} & {1 << i}) <> 0 THEN '{b}' ELSE '' END" for i, b in enumerate("ACGT")) + ")"
    comp = "(((e & 17) << 3) | ((e & 34) << 1) | ((e & 68) >> 1) | ((e & 136) >> 3))"
    diff = lambda n, a="seq", b="other": " + ".join(f"CAST(substr({a}, {i}, 1) <> substr({b}, {i}, 1) AS BIGINT)" for i in range(1, n + 1))
    out = {
        "kmer_count": km + " SELECT kmer, exts, n, CAST(data AS INTEGER) AS seen FROM km",
        "kmer_count_stranded": f"{doc}, {counted(12, MIN_OBS, stranded=True)} SELECT kmer, exts, n FROM km",
        "seq_places": key + "SELECT id, CAST(length(seq) AS INTEGER) AS n, true AS cleared, substr(seq, CAST(id % 32 AS INTEGER) + 1, 1) AS base, CASE WHEN id % 32 + 9 <= 32 THEN substr(seq, CAST(id % 32 AS INTEGER) + 1, 9) END AS at, "
        "substr(seq, 1, 5) AS first, right(seq, 5) AS last, CASE WHEN id % 2 = 0 THEN right(seq, 7) ELSE substr(seq, 1, 7) END AS by_side FROM key",
        "seq_builders": key + f", c AS (SELECT *, substr(md5(CAST(id AS VARCHAR)), 1, 1) AS ch FROM key) SELECT id, repeat('A', CAST(id % 40 AS INTEGER)) AS blank, seq || substr(other, 1, 1) AS first_of_other, "
        "CASE WHEN id % 5 < 4 THEN seq || substr('ACGT', CAST(id % 5 AS INTEGER) + 1, 1) END AS pushed, seq || substr(other, 1, 6) AS longer, "
        "CASE ch WHEN 'a' THEN 0 WHEN 'c' THEN 1 END AS strict, CASE ch WHEN 'c' THEN 1 ELSE 0 END AS lenient, CASE ch WHEN 'c' THEN 2 ELSE 3 END AS complement FROM c",
        "exts_sides": key + f""", e AS (SELECT *, CAST(id * 11 % 256 AS INTEGER) AS x, substr(seq, 1, 8) AS k FROM key),
            b AS (SELECT id, string_agg(c, '' ORDER BY c) FILTER (x & (1 << i) > 0) AS l, string_agg(c, '' ORDER BY c) FILTER (x & (16 << i) > 0) AS r,
                  string_agg(c || substr(k, 1, 7), ',' ORDER BY c) FILTER (x & (1 << i) > 0) AS tl, string_agg(substr(k, 2) || c, ',' ORDER BY c) FILTER (x & (16 << i) > 0) AS tr
                  FROM e, (SELECT unnest(['A', 'C', 'G', 'T']) AS c, CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS i) GROUP BY id)
            SELECT id, id % 2 = 0 AS flip, (id % 2 = 1) <> (id % 3 = 0) AS cond_flip, CASE WHEN id % 2 = 1 THEN other ELSE seq END AS pick, coalesce(l, '') AS left, coalesce(r, '') AS right, coalesce(tl, '') AS to_left, coalesce(tr, '') AS to_right, '|' AS none FROM e JOIN b USING (id)""",
        "kmer_sorted": f"{doc}, {counted(20, MIN_OBS)} SELECT kmer, n, row_number() OVER (ORDER BY kmer) - 1 AS place FROM km",
        "set_slices": f"""{doc}, line AS (SELECT string_agg(seq, '' ORDER BY seq_id) AS s FROM doc), q AS (SELECT i AS query, CAST(floor(i * length(s) / {LOOKUPS}.0) AS BIGINT) AS a FROM line, range({LOOKUPS}) x(i))
            SELECT query, substr(s, a + 1, 200 + query * 7 % 800) AS seq FROM q, line""",
        "set_get_slice": f"{doc} SELECT seq_id AS query, substr(seq, 11, 50) AS seq FROM doc WHERE length(seq) > 10",
        "graph_nth_kmers": f"""WITH RECURSIVE {graph_ctes()}, kn AS (SELECT row_number() OVER (ORDER BY node_id, i) - 1 AS n, substr(seq, i, {K}) AS kmer FROM (SELECT node_id, seq, CAST(unnest(range(1, length(seq) - {K} + 2)) AS INTEGER) AS i FROM nd)),
            tot AS (SELECT count(*) AS t FROM kn), q AS (SELECT i AS query, CAST(floor(i * t / {LOOKUPS}.0) AS BIGINT) AS n FROM tot, range({LOOKUPS}) x(i)) SELECT query, kmer FROM q JOIN kn USING (n)""",
        "kmer_function_summary": f"""{doc}, {observations(12)}, lc AS (SELECT kmer, coalesce(label, '') AS label, bit_or(exts) AS exts, count(*) AS n FROM obs GROUP BY ALL)
            SELECT kmer, CAST(bit_or(exts) AS INTEGER) AS exts, CAST(sum(n) AS BIGINT) AS n, string_agg(label || ':' || n, ',' ORDER BY label) AS counts FROM lc GROUP BY kmer HAVING count(*) > 1""",
        "kmer_count_by_segments": km + " SELECT kmer, exts, n, CAST(data AS INTEGER) AS seen FROM km",
        "kmer_colors": f"{doc}, {counted(20, MIN_OBS, colors=True)} SELECT kmer, exts, n, data AS colors FROM km",
        "kmer_colors_by_segments": f"{doc}, {counted(20, MIN_OBS, colors=True)} SELECT kmer, exts, n, data AS colors FROM km",
        "kmer_all_report": f"{doc}, {observations(20)} SELECT kmer, count(*) >= {MIN_OBS} AS valid FROM obs GROUP BY kmer",
        "kmer_saturated": f"{doc}, {counted(4, 1)} SELECT kmer, n, CAST(data AS INTEGER) AS seen FROM km",
        "kmer_total": f"{doc} SELECT CAST(coalesce(sum(greatest(length(seq) - {K - 1}, 0)), 0) AS BIGINT) AS total FROM doc",
        "seq_rc": key + f"SELECT id, {rc('seq')} AS rc FROM key",
        "seq_canonical": key + f"SELECT id, least(seq, {rc('seq')}) AS canon, seq >= {rc('seq')} AS flip FROM key",
        "kmer_rank": key + f"SELECT id, CAST({_rank_dna(K)} AS BIGINT) AS rank FROM key",
        "kmer_unrank": key + "SELECT id, substr(seq, 1, 20) AS kmer FROM key",
        "gc_at_count": key + f"SELECT id, CAST(length(regexp_replace(seq, '[AT]', '', 'g')) AS BIGINT) AS gc, CAST(length(regexp_replace(substr(seq, 1, {K}), '[GC]', '', 'g')) AS BIGINT) AS at FROM key",
        "hamming_pairs": key + f"SELECT id, {diff(32)} AS dist, {diff(K)} AS dist_packed FROM key",
        "is_palindrome": key + f"SELECT id, seq = {rc('seq')} AS whole, substr(seq, 1, 4) = {rc('substr(seq, 1, 4)')} AS four, true AS made FROM key",
        "set_base": key + "SELECT id, substr(seq, 1, CAST(id % 32 AS INTEGER)) || 'A' || substr(seq, CAST(id % 32 AS INTEGER) + 2) AS one, substr(seq, 1, 8) || substr(other, 1, 5) || substr(seq, 14) AS slice FROM key",
        "slice_prefix_suffix": key + "SELECT id, substr(seq, 4, 14) AS cut, substr(seq, 1, 6) AS head, right(seq, 6) AS tail, substr(seq, 16, 14) AS rc_cut FROM key",
        "reverse_only": key + "SELECT id, reverse(seq) AS rev FROM key",
        "extend_lr": key + f"SELECT id, 'G' || substr(seq, 1, {K - 1}) AS l, substr(seq, 2, {K - 1}) || 'T' AS r, CASE WHEN id % 2 = 0 THEN substr(seq, 2, {K - 1}) || 'C' ELSE 'C' || substr(seq, 1, {K - 1}) END AS by_dir FROM key",
        "hamming1_neighbors": f"WITH c AS (SELECT c_custkey AS id, substr(translate(md5(CAST(c_custkey AS VARCHAR)), '{HEX}', '{AS_DNA}'), 1, 12) AS s FROM customer) SELECT id, substr(s, 1, i - 1) || b || substr(s, i + 1) AS kmer FROM c, (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS i), (SELECT unnest(['A','C','G','T']) AS b) WHERE b <> substr(s, i, 1)",
        "exts_algebra": "WITH x AS (SELECT o_orderkey AS id, CAST(o_orderkey % 256 AS INTEGER) AS e, CAST((o_orderkey * 7 + 3) % 256 AS INTEGER) AS f FROM orders) SELECT id, "
        + ", ".join(f"CAST({sql} AS INTEGER) AS {name}" for name, sql in {"comp": comp, "rev": "((e & 15) << 4) | (e >> 4)", "rc": rc_exts("e"), "merged": "(e & 15) | (f & 240)", "added": "e | f", "joined": "((f & 15) << 4) | (e & 15)", "with_g": "e | 64", "nl": bits(nib("e", False)), "nr": bits(nib("e", True)), "right_low": nib("e", True)}.items())
        + f", (e & 2) <> 0 AS left_c, CASE e >> 4 WHEN 1 THEN 'A' WHEN 2 THEN 'C' WHEN 4 THEN 'G' WHEN 8 THEN 'T' END AS only_right, {letters(nib('e', False))} || '|' || {letters(nib('e', True))} AS text FROM x",
        "dna_lenient": "SELECT doc_id, translate(regexp_replace(text, '[^ACGTacgt]', 'A', 'g'), 'acgt', 'ACGT') AS seq FROM documents",
        "hash_n": "SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda c, i: CASE WHEN instr('ACGTacgt', c) > 0 THEN upper(c) ELSE substr('ACGT', CAST((instr('0123456789abcdef', left(md5(doc_id || ':' || (i - 1)), 1)) - 1) % 4 + 1 AS INTEGER), 1) END), '') AS seq FROM documents",
        "dna_only_split": "SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, upper(runs[i]) AS run FROM (SELECT doc_id, runs, unnest(range(1, len(runs) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[ACGTacgt]+') AS runs FROM documents))",
        "codes_roundtrip": key + "SELECT id, translate(seq, 'ACGT', '0123') AS codes, seq AS back FROM key",
        "push_packed": key + "SELECT id, " + " || ',' || ".join("CAST(" + " + ".join(f"{code(f'substr(seq, {4 * g + j + 1}, 1)')} * {4**j}" for j in range(4)) + " AS VARCHAR)" for g in range(8)) + " AS bytes, substr(seq, 1, 30) AS first30 FROM key",
        "exts_censored": f"{km}, {targets('km')} {repaired('km', 'j.kmer IS NOT NULL')}",
        "exts_censored_local": f"{km}, {targets('km')} {repaired('km', 'j.kmer IS NOT NULL')}",
        "exts_censored_sharded": f"{km}, dropped AS MATERIALIZED (SELECT kmer FROM obs GROUP BY kmer HAVING count(*) < {MIN_OBS}), {targets('km')} {repaired('km', 'j.kmer IS NULL OR substr(t.kmer, 1, 2) <> substr(t.target, 1, 2)', 'dropped')}",
        "exts_censored_all_shards": f"{km}, dropped AS MATERIALIZED (SELECT kmer FROM obs GROUP BY kmer HAVING count(*) < {MIN_OBS}), {targets('km')} {repaired('km', f'j.kmer IS NULL OR {_shard('t.kmer')} <> {_shard('t.target')}', 'dropped')}",
        "exts_from_set": f"{km}, allx AS (SELECT kmer, 255 AS exts FROM km), {targets('allx')} {repaired('km', 'j.kmer IS NOT NULL')}",
        "msp_bucket": key
        + f", pm AS (SELECT id, j, CAST({rank('c', 6)} AS BIGINT) AS r FROM (SELECT id, j, least(p, {rc('p')}) AS c FROM (SELECT id, j, substr(seq, j, 6) AS p FROM (SELECT id, seq, CAST(unnest(range(1, 28)) AS INTEGER) AS j FROM key)))), win AS (SELECT id, j, min(r) OVER (PARTITION BY id ORDER BY j ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS bucket FROM pm) SELECT id AS seq_id, CAST(j - 1 AS BIGINT) AS pos, bucket FROM win WHERE j <= 13",
        "msp_kmer_cover": f"{km} SELECT kmer, exts, n FROM km",
        "unitigs_ordered": f"""WITH RECURSIVE {DOC}, {counted(K, MIN_OBS)}, {unitig_ctes(K)}, ord AS (SELECT *, lag(data) OVER (PARTITION BY start ORDER BY pos) AS prev FROM mem),
            per AS (SELECT string_agg(CASE WHEN pos = 0 THEN ok ELSE right(ok, 1) END, '' ORDER BY pos) AS seq, arg_min(data, pos) AS a, arg_max(data, pos) AS b, count(*) FILTER (prev IS NULL OR prev <> data) AS runs FROM ord GROUP BY start)
            SELECT DISTINCT least(seq, {rc('seq')}) AS seq, CAST(least(a, b) AS INTEGER) AS low_end, CAST(greatest(a, b) AS INTEGER) AS high_end, CAST(runs AS INTEGER) AS runs FROM per""",
        "unitigs": f"WITH RECURSIVE {DOC}, {counted(K, MIN_OBS)}, {unitig_ctes(K)} {UNI}",
        "unitigs_stranded": f"WITH RECURSIVE {DOC}, {counted(12, MIN_OBS, stranded=True)}, {stranded_ctes(12)} {UNI}",
        "unitigs_keys": f"WITH RECURSIVE {KEY}, src AS (SELECT seq, '' AS label FROM key), {counted(24, 1, source='src')}, {unitig_ctes(24)} {UNI}",
        "unitigs_colored": f"WITH RECURSIVE {DOC}, {counted(K, MIN_OBS, colors=True)}, {unitig_ctes(K, equal_data=True)} SELECT seq, CAST(exts AS INTEGER) AS exts, CAST(members AS BIGINT) AS members, data AS colors FROM uni",
        "graph_edges": graph + "SELECT * FROM ed",
        "graph_is_compressed": graph + f", {CLEANED}, lone AS (SELECT src, src_dir FROM ke GROUP BY src, src_dir HAVING count(*) = 1) SELECT count(*) AS before, CAST(0 AS BIGINT) AS pairs FROM ke JOIN lone a ON a.src = ke.src AND a.src_dir = ke.src_dir JOIN lone b ON b.src = ke.dst AND b.src_dir = ke.dst_side WHERE ke.src <> ke.dst",
        "msp_segments": msp_segment_sql(K, 8),
        "msp_simple_scan": msp_segment_sql(16, 5, doc=KEY + ", doc AS (SELECT id AS seq_id, seq FROM key)", score=f"least(reverse(m), reverse({rc('m')}))").replace("SELECT seq_id, CAST(seg_no", "SELECT seq_id, bucket, start, len FROM (SELECT seq_id, CAST(seg_no") + ")",
        "max_path": f"WITH RECURSIVE {max_path_ctes(20)} SELECT pos, node_id, dir FROM mp",
        "path_sequence": f"WITH RECURSIVE {max_path_ctes(20)} SELECT string_agg(CASE WHEN pos = 0 THEN own ELSE substr(own, 20) END, '' ORDER BY pos) AS seq FROM (SELECT pos, CASE WHEN dir = 'R' THEN {rc('seq')} ELSE seq END AS own FROM mp JOIN nd USING (node_id))",
        "beam_path": f"WITH RECURSIVE {beam_path_ctes(4)}, top AS (SELECT path FROM bm WHERE it = (SELECT max(it) FROM bm) ORDER BY score DESC, o1 LIMIT 1) SELECT CAST(i - 1 AS BIGINT) AS pos, path[i].node_id AS node_id, path[i].dir AS dir FROM (SELECT path, unnest(range(1, len(path) + 1)) AS i FROM top)",
        "graph_stored": graph + f"SELECT node_id, seq, exts, {K} AS k, false AS stranded FROM nd",
        "graph_added": graph + f""", more AS (SELECT seq, exts, members FROM nd UNION ALL SELECT translate(md5(CAST(c_custkey AS VARCHAR)), '{HEX}', '{AS_DNA}'), 0, 1 FROM customer),
            al AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS node_id, seq, exts, CAST(members AS BIGINT) AS members FROM more) SELECT * FROM al WHERE node_id % 10 = 9""",
        "graph_combine": graph + "SELECT node_id, seq, exts FROM nd",
        "graph_fix_exts": graph + "SELECT n.node_id, CAST(coalesce(b.e, 0) AS INTEGER) AS exts FROM nd n LEFT JOIN (SELECT ed.src, bit_or(bit) AS e FROM ed JOIN bits ON bits.base = ed.base AND bits.side = ed.src_dir WHERE dst % 2 = 0 GROUP BY ed.src) b ON b.src = n.node_id",
        "graph_find_link": graph + f", pq AS (SELECT node_id AS src, {other('side')} AS dir, kmer FROM ends UNION SELECT node_id, side, CASE WHEN side = 'R' THEN right(seq, {K - 1}) || base ELSE base || substr(seq, 1, {K - 1}) END FROM nd, bits WHERE (exts & bit) <> 0), fh AS (SELECT p.*, 0 AS try, e.node_id AS dst, e.side AS dst_side FROM pq p JOIN ends e ON e.kmer = p.kmer AND e.side = {other('p.dir')} UNION ALL SELECT p.*, 1, e.node_id, e.side FROM pq p JOIN ends e ON e.kmer = {rc('p.kmer')} AND e.side = p.dir) SELECT src, dir, kmer, dst, dst_side, try = 1 AS rc FROM (SELECT *, row_number() OVER (PARTITION BY src, dir, kmer ORDER BY try, dst, dst_side) AS rn FROM fh) WHERE rn = 1",
        "node_kmers": graph + f"SELECT node_id, CAST(i - 1 AS BIGINT) AS pos, substr(seq, CAST(i AS INTEGER), {K}) AS kmer FROM (SELECT node_id, seq, unnest(range(1, length(seq) - {K} + 2)) AS i FROM nd)",
        "node_degree": graph + f"SELECT node_id, CAST({bits(nib('exts', False))} AS INTEGER) AS nl, CAST({bits(nib('exts', True))} AS INTEGER) AS nr FROM nd",
        "tips": graph + f"SELECT node_id FROM (SELECT node_id, length(seq) AS n, {bits(nib('exts', False))} AS nl, {bits(nib('exts', True))} AS nr FROM nd) WHERE n < {2 * K} AND ((nl = 0 AND nr <= 1) OR (nr = 0 AND nl <= 1))",
        "gfa_lines": graph + f"SELECT CAST(-1 AS BIGINT) AS node_id, CAST(0 AS INTEGER) AS line_no, 'H' || chr(9) || 'VN:Z:1.0' || chr(9) || 'PR:Z:kmerloom' AS line UNION ALL SELECT node_id, 0, concat_ws(chr(9), 'S', node_id, seq, 'KC:i:' || data) FROM nd UNION ALL SELECT src, CAST(CASE WHEN src_dir = 'L' THEN 1 ELSE 5 END + instr('ACGT', base) - 1 AS INTEGER), concat_ws(chr(9), 'L', src, CASE WHEN src_dir = 'L' THEN '-' ELSE '+' END, dst, CASE WHEN dst_side = 'L' THEN '+' ELSE '-' END, '{K - 1}M') FROM ed WHERE (src_dir = 'L' AND dst >= src) OR (src_dir = 'R' AND dst > src)",
        "dot_lines": graph + "SELECT CAST(-1 AS BIGINT) AS node_id, 'digraph {' AS line UNION ALL SELECT CAST(4611686018427387904 AS BIGINT), '}' UNION ALL SELECT node_id, concat('n', node_id, ' [label=\"id:', node_id, ' len:', length(seq), '  ', data, '\",style=filled]') FROM nd UNION ALL SELECT src, concat('n', CASE WHEN src_dir = 'L' THEN dst ELSE src END, ' -> n', CASE WHEN src_dir = 'L' THEN src ELSE dst END, ' [color=', CASE WHEN dst_side = 'L' THEN 'blue' ELSE 'red' END, ']') FROM ed",
        "json_nodes": graph + "SELECT node_id, concat('{\"id\":\"', node_id, '\",\"L\":', length(seq), ',\"D\":', data, ',\"Se\":\"', seq, '\"}') AS line FROM nd",
        "json_links": graph + "SELECT src AS node_id, concat('{\"source\":\"', src, '\",\"target\":\"', dst, '\",\"D\":\"', dst_side, '\"}') AS line FROM ed WHERE src_dir = 'R'",
    }
    out["json_document_rest"] = f"""SELECT 0 AS part, CAST(0 AS BIGINT) AS node_id, '{{"nodes":[' AS line UNION ALL SELECT 2, 0, '],"links":[' UNION ALL SELECT 4, 0, '],"k":{K},"of":{{"table":"documents"}}}}'"""
    out["gfa_source"] = graph + "SELECT line FROM (" + out["gfa_lines"].removeprefix(graph) + ")"
    node, link = out["json_nodes"].removeprefix(graph), out["json_links"].removeprefix(graph)
    out["json_document"] = graph + f", jn AS ({node}), jl AS ({link}) SELECT CAST(1 AS INTEGER) AS part, node_id, CASE WHEN row_number() OVER (ORDER BY node_id) > 1 THEN ',' ELSE '' END || line AS line FROM jn UNION ALL SELECT 3, node_id, CASE WHEN row_number() OVER (ORDER BY node_id, line) > 1 THEN ',' ELSE '' END || line FROM jl UNION ALL SELECT 0, 0, '{{\"nodes\":[' UNION ALL SELECT 2, 0, '],\"links\":[' UNION ALL SELECT 4, 0, ']}}'"
    # K-mers of the nodes that stay; a node's first one carries its data, and 2**32 to count nodes by.
    place = f"SELECT node_id, substr(seq, CAST(i AS INTEGER), {K}) AS w, CASE WHEN i > 1 THEN {ext_bit('substr(seq, CAST(i AS INTEGER) - 1, 1)', 'false')} ELSE exts & 15 END | CASE WHEN i + {K} <= length(seq) THEN {ext_bit(f'substr(seq, CAST(i AS INTEGER) + {K}, 1)', 'true')} ELSE exts & 240 END AS x, CASE WHEN i = 1 THEN CAST(data AS BIGINT) + 4294967296 ELSE 0 END AS data FROM (SELECT *, unnest(range(1, length(seq) - {K} + 2)) AS i FROM kd)"
    turned = f"SELECT least(w, {rc('w')}) AS kmer, CAST(CASE WHEN w >= {rc('w')} THEN {rc_exts('x')} ELSE x END AS INTEGER) AS exts, data FROM ({place})"
    out["tip_cleaned_unitigs"] = graph + f""", {CLEANED}, ckm AS ({turned}), again AS (WITH RECURSIVE {unitig_ctes(K, table='ckm', join_data='sum(data)')} SELECT * FROM uni)
    SELECT min(least(w, {rc('w')})) AS least_kmer, CAST(length(seq) AS BIGINT) AS len, CAST(CAST(data AS BIGINT) >> 32 AS BIGINT) AS members, CAST(least(CAST(data AS BIGINT) & 4294967295, 65535) AS BIGINT) AS data
    FROM (SELECT seq, data, substr(seq, CAST(unnest(range(1, length(seq) - {K} + 2)) AS INTEGER), {K}) AS w FROM again) GROUP BY seq, data"""
    censored = f"{DOC}, {counted(K, MIN_OBS)}, {targets('km')}, ckm AS (SELECT k.kmer, CAST(coalesce(b.e, 0) AS INTEGER) AS exts, k.data FROM km k LEFT JOIN (SELECT kmer, bit_or(bit) AS e FROM tg WHERE target IN (SELECT kmer FROM km) GROUP BY kmer) b ON b.kmer = k.kmer)"
    from_set = f"{DOC}, {counted(K, MIN_OBS)}, allx AS (SELECT kmer, 255 AS exts FROM km), {targets('allx')}, ckm AS (SELECT k.kmer, CAST(coalesce(b.e, 0) AS INTEGER) AS exts, k.data FROM km k LEFT JOIN (SELECT kmer, bit_or(bit) AS e FROM tg WHERE target IN (SELECT kmer FROM km) GROUP BY kmer) b ON b.kmer = k.kmer)"
    short = "SELECT seq, CAST(length(seq) AS BIGINT) AS len, CAST(exts AS INTEGER) AS exts, CAST(data AS BIGINT) AS data FROM uni"
    out["unitigs_repaired"] = f"WITH RECURSIVE {censored}, {unitig_ctes(K, table='ckm')} {short}"
    kmer = f"substr(seq, CAST(i AS INTEGER), {K})"
    out["unitigs_sharded"] = f"WITH RECURSIVE {censored}, {unitig_ctes(K, table='ckm')} SELECT min(least({kmer}, {rc(kmer)})) AS least_kmer, CAST(length(seq) AS BIGINT) AS len, CAST(data AS BIGINT) AS data FROM (SELECT seq, data, unnest(range(1, length(seq) - {K} + 2)) AS i FROM uni) GROUP BY seq, data"
    out["unitigs_no_exts"] = f"WITH RECURSIVE {from_set}, {unitig_ctes(K, table='ckm')} {UNI}"
    return out
