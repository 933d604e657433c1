"""The catalog's queries once more, as plain SQL over the driver's tables."""

from __future__ import annotations

from strandweave.views import BASES, LETTERS

K = 21
MOTIFS = ("ACG", "CGT")
MIN_SCORE, PENALTY, MAX_DROP = 2, 1, 20


def _bases(col: str) -> str:
    return f"translate(upper(regexp_replace({col}, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}')"


def _rc(expr: str) -> str:
    return f"translate(reverse({expr}), 'ACGTN', 'TGCAN')"


def _code(word: str, k: int) -> str:
    return "(" + " + ".join(f"(strpos('ACGT', {word}[{i + 1}]) - 1)::BIGINT * {4 ** (k - 1 - i)}" for i in range(k)) + ")"


def _node(real: str, orient: str) -> str:
    return f"CASE WHEN {orient} = '+' THEN {real} ELSE xor({real}, 1) END"


def _flip(orient: str) -> str:
    return f"CASE WHEN {orient} = '+' THEN '-' ELSE '+' END"


def _slice_len(n: str, stop: str) -> str:
    return f"CASE WHEN {stop} >= 0 THEN least({n}, {stop}) ELSE greatest({n} + {stop}, 0) END"


CTES: dict[str, str] = {}
CTES["reads"] = f"""SELECT doc_id, 'r' || doc_id AS read_id, seq, length(seq) AS read_len
 FROM (SELECT doc_id, {_bases('text')} AS seq FROM documents)"""

# ------------------------------------------------------------------------- overlaps
CTES["paf"] = """SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ln,
 id1, len1, s1 AS start1, s1 + ol AS end1, strand, id2, len2, s2 AS start2, s2 + ol AS end2 FROM (
 SELECT *, CASE WHEN kind IN (0, 2) THEN len1 - ol WHEN kind = 4 THEN least(10, len1 - ol) ELSE 0 END AS s1,
  CASE WHEN kind IN (1, 2) THEN len2 - ol WHEN kind = 4 THEN least(20, len2 - ol) ELSE 0 END AS s2 FROM (
 SELECT l.*, a.read_id AS id1, a.read_len AS len1, b.read_id AS id2, b.read_len AS len2, l_linenumber % 5 AS kind,
  CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand,
  1 + (l_suppkey * 50 + CAST(l_quantity AS BIGINT)) % least(a.read_len, b.read_len) AS ol
 FROM lineitem l JOIN reads a ON a.doc_id = l_partkey // 2 JOIN reads b ON b.doc_id = l_orderkey // 15
 WHERE l_partkey // 2 <> l_orderkey // 15))"""
CTES["cls"] = """SELECT *, CASE WHEN c[1] = '1' THEN id1 ELSE id2 END AS src_read, c[2] AS src_orient,
 CASE WHEN c[1] = '1' THEN id2 ELSE id1 END AS dst_read, c[4] AS dst_orient, end1 - start1 AS ol_len,
 CASE WHEN c[1] = '1' THEN len1 ELSE len2 END AS src_len, CASE WHEN c[1] = '1' THEN len2 ELSE len1 END AS dst_len,
 CASE WHEN c[1] = '1' THEN start1 ELSE start2 END AS src_start, CASE WHEN c[1] = '1' THEN end1 ELSE end2 END AS src_end,
 CASE WHEN c[1] = '1' THEN start2 ELSE start1 END AS dst_start, CASE WHEN c[1] = '1' THEN end2 ELSE end1 END AS dst_end
 FROM (SELECT *, CASE WHEN strand = '+' THEN
   CASE WHEN start1 = 0 AND start2 = 0 THEN NULL WHEN end1 = len1 AND end2 = len2 THEN NULL
    WHEN end1 = len1 AND start2 = 0 THEN '1+2+' WHEN start1 = 0 AND end2 = len2 THEN '2+1+' END
  ELSE CASE WHEN start1 = 0 AND end2 = len2 THEN NULL WHEN end1 = len1 AND start2 = 0 THEN NULL
    WHEN end1 = len1 AND end2 = len2 THEN '1+2-' WHEN start1 = 0 AND start2 = 0 THEN '1-2+' END END AS c FROM paf)
 WHERE c IS NOT NULL"""

# ----------------------------------------------------------------- raw unitig graph
CTES["members"] = f"""SELECT doc_id // 3 AS utg, doc_id, read_id, CASE WHEN quality = 1 THEN '+' ELSE '-' END AS orient,
 CASE WHEN quality = 1 THEN seq ELSE {_rc('seq')} END AS oseq, read_len FROM reads JOIN labels USING (doc_id)"""
CTES["segs"] = """SELECT utg, 2 * (row_number() OVER (ORDER BY utg) - 1) AS real_id, seq, length(seq) AS n,
 'utg' || lpad(utg::VARCHAR, 9, '0') || 'l' AS name
 FROM (SELECT utg, string_agg(oseq, '' ORDER BY doc_id) AS seq FROM members GROUP BY utg)"""
CTES["rawlinks"] = f"""SELECT o_orderkey * 2 + m AS ln, CASE WHEN m = 0 THEN s ELSE xor(d, 1) END AS s,
 CASE WHEN m = 0 THEN d ELSE xor(s, 1) END AS d, ol FROM (
 SELECT o_orderkey, {_node('sa.real_id', 'o1')} AS s, {_node('sb.real_id', 'o2')} AS d, 1 + o_orderkey % least(sa.n, sb.n) AS ol
 FROM (SELECT o_orderkey, o_custkey * 2 // 3 AS a, o_orderkey // 15 AS b, CASE WHEN o_orderstatus = 'F' THEN '+' ELSE '-' END AS o1,
   CASE WHEN substr(o_orderpriority, 1, 1) <= '3' THEN '+' ELSE '-' END AS o2 FROM orders)
 JOIN members ma ON ma.doc_id = a JOIN members mb ON mb.doc_id = b
 JOIN segs sa ON sa.utg = ma.utg JOIN segs sb ON sb.utg = mb.utg WHERE ma.utg <> mb.utg), (VALUES (0), (1)) t(m)"""
CTES["rawnodes"] = """SELECT real_id + v AS node_id, name, CASE WHEN v = 0 THEN '+' ELSE '-' END AS orient, n AS read_len, real_id
 FROM segs, (VALUES (0), (1)) t(v)"""
CTES["rawedges"] = """SELECT src, dst, arg_max(ol, (ln, tie)) AS ol_len, any_value(read_len) - arg_max(ol, (ln, tie)) AS prefix_len
 FROM (SELECT s AS src, d AS dst, ol, ln, 0 AS tie, 1 AS listed FROM rawlinks
  UNION ALL SELECT xor(d, 1), xor(s, 1), ol, ln, 1, 0 FROM rawlinks) JOIN rawnodes ON node_id = src
 GROUP BY src, dst HAVING max(listed) = 1"""
CTES["rawends"] = """SELECT real_id, count(*) AS n, arg_min(read_id, doc_id) AS first, arg_min(orient, doc_id) AS first_orient,
 arg_max(read_id, doc_id) AS last, arg_max(orient, doc_id) AS last_orient FROM members JOIN segs USING (utg) GROUP BY real_id"""
CTES["rawread"] = "SELECT read_id, real_id FROM members JOIN segs USING (utg)"

# ------------------------------------------------------------------- final contigs
CTES["arows"] = """SELECT l.doc_id AS ln, CASE WHEN lang = 'en' THEN 'ctg_en' ELSE 'ctg' || (l.doc_id // 16) END AS contig,
 l.doc_id * 300 AS start, CASE WHEN quality = 1 THEN '+' ELSE '-' END AS orient, toxic = 1 AS is_gap, read_id,
 l.doc_id % 3 AS rstart, read_len AS rend FROM labels l JOIN documents d ON d.doc_id = l.doc_id JOIN reads r ON r.doc_id = l.doc_id"""
CTES["crows"] = """SELECT contig, pos, ln, start, orient, CASE WHEN is_gap THEN 'custom_n_' || (next_start - start) ELSE read_id END AS name,
 rstart, rend, CASE WHEN is_gap THEN next_start - start END AS gap_len, next_start FROM (
 SELECT *, row_number() OVER (PARTITION BY contig ORDER BY start) - 1 AS pos, lead(start) OVER (PARTITION BY contig ORDER BY start) AS next_start
 FROM (SELECT *, min(CASE WHEN NOT is_gap THEN start END) OVER (PARTITION BY contig) AS lo,
   max(CASE WHEN NOT is_gap THEN start END) OVER (PARTITION BY contig) AS hi FROM arows) WHERE start BETWEEN lo AND hi)"""
CTES["cids"] = """SELECT name, read_len, gap_len, 2 * (row_number() OVER (ORDER BY grp, ord, name) - 1) AS real_id FROM (
 SELECT DISTINCT name, coalesce(gap_len, read_len) AS read_len, gap_len, CASE WHEN gap_len IS NULL THEN 0 ELSE 1 END AS grp,
  coalesce(gap_len, 0) AS ord FROM crows LEFT JOIN reads ON read_id = name)"""
CTES["cnos"] = """SELECT contig, row_number() OVER (ORDER BY ln) - 1 AS contig_no
 FROM (SELECT contig, min(ln) AS ln FROM crows GROUP BY contig)"""
CTES["cplaced"] = f"""SELECT c.*, contig_no, read_len, {_node('real_id', 'orient')} AS node_id
 FROM crows c JOIN cids i ON i.name = c.name JOIN cnos USING (contig)"""
CTES["cnodes"] = """SELECT real_id + v AS node_id, name, CASE WHEN v = 0 THEN '+' ELSE '-' END AS orient, read_len
 FROM cids, (VALUES (0), (1)) t(v)"""
CTES["cseqs"] = """SELECT i.name, coalesce(seq, repeat('N', gap_len::INT)) AS seq FROM cids i LEFT JOIN reads ON read_id = name"""
CTES["cedges"] = """SELECT src, dst, 0 AS ol_len, arg_min(prefix_len, (contig_no, pos)) AS prefix_len FROM (
 SELECT contig_no, pos, node_id AS src, lead(node_id) OVER w AS dst, lead(start) OVER w - start AS prefix_len FROM cplaced
 WINDOW w AS (PARTITION BY contig_no ORDER BY pos)) WHERE dst IS NOT NULL GROUP BY src, dst"""
CTES["cends"] = "SELECT real_id, 1 AS n, name AS first, '+' AS first_orient, name AS last, '+' AS last_orient FROM cids"
CTES["cread"] = "SELECT name AS read_id, real_id FROM cids"
CTES["csteps"] = """SELECT w.contig_no AS walk_id, w.pos, w.node_id, w.next_node, e.prefix_len, e.ol_len FROM (
 SELECT *, lead(node_id) OVER (PARTITION BY contig_no ORDER BY pos) AS next_node FROM cplaced) w
 LEFT JOIN cedges e ON e.src = w.node_id AND e.dst = w.next_node"""
CTES["cpieces"] = f"""SELECT *, coalesce(sum(piece_len) OVER (PARTITION BY walk_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
 FROM (SELECT s.walk_id, s.pos, s.node_id, s.prefix_len AS take, n.name, n.orient,
 CASE WHEN next_node IS NULL THEN read_len ELSE {_slice_len('read_len', 'prefix_len')} END AS piece_len
 FROM csteps s JOIN cnodes n ON n.node_id = s.node_id)"""
CTES["ctext"] = f"""SELECT walk_id, string_agg(substr(CASE WHEN orient = '+' THEN seq ELSE {_rc('seq')} END, 1, piece_len::INT), '' ORDER BY pos) AS seq
 FROM cpieces JOIN cseqs USING (name) GROUP BY walk_id"""


def _accepted(prefix: str, ends: str, read: str, edges: str, rounds: int = 6) -> dict[str, str]:
    """Ordered greedy acceptance, unrolled into rounds of rows first under all their keys."""
    def outer(side: str) -> str:
        start, end, n = f"{side}_start = 0", f"{side}_end = {side}_len", f"{side}_read"
        return f"""CASE WHEN coalesce({side}e.n, 1) <= 1 THEN true
          WHEN {n} = {side}e.first THEN CASE WHEN {side}e.first_orient = '+' THEN {start} ELSE {end} END
          WHEN {n} = {side}e.last THEN CASE WHEN {side}e.last_orient = '+' THEN {end} ELSE {start} END ELSE false END"""

    out = {}
    out[f"{prefix}loc"] = f"""SELECT c.*, {_node('sr.real_id', 'src_orient')} AS src_node, {_node('dr.real_id', 'dst_orient')} AS dst_node,
      coalesce(srce.n, dste.n, 1) > 1 AS multi
     FROM cls c LEFT JOIN {read} sr ON sr.read_id = src_read LEFT JOIN {read} dr ON dr.read_id = dst_read
     LEFT JOIN {ends} srce ON srce.real_id = sr.real_id LEFT JOIN {ends} dste ON dste.real_id = dr.real_id
     WHERE (sr.real_id IS DISTINCT FROM dr.real_id OR sr.real_id IS NULL) AND {outer('src')} AND {outer('dst')}"""
    out[f"{prefix}u0"] = f"""SELECT *, least(id1, id2) || '|' || greatest(id1, id2) AS k1, CASE
      WHEN src_node IS NOT NULL AND dst_node IS NOT NULL THEN 'e' || least(src_node || '>' || dst_node, xor(dst_node, 1) || '>' || xor(src_node, 1))
      WHEN src_node IS NOT NULL AND multi THEN 'g' || dst_orient || src_node || '|' || dst_read
      WHEN dst_node IS NOT NULL AND multi THEN 'g' || src_orient || dst_node || '|' || src_read END AS k2
     FROM {prefix}loc l WHERE src_node IS NULL OR dst_node IS NULL OR NOT EXISTS (SELECT 1 FROM {edges} e WHERE
      (e.src = l.src_node AND e.dst = l.dst_node) OR (e.src = xor(l.dst_node, 1) AND e.dst = xor(l.src_node, 1)))"""
    for i in range(rounds):
        u, a = f"{prefix}u{i}", f"{prefix}a{i}"
        out[a] = f"""SELECT * FROM {u} WHERE ln IN (SELECT min(ln) FROM {u} GROUP BY k1)
         AND (k2 IS NULL OR ln IN (SELECT min(ln) FROM {u} WHERE k2 IS NOT NULL GROUP BY k2))"""
        out[f"{prefix}u{i + 1}"] = f"""SELECT * FROM {u} WHERE k1 NOT IN (SELECT k1 FROM {a})
         AND (k2 IS NULL OR k2 NOT IN (SELECT k2 FROM {a} WHERE k2 IS NOT NULL))"""
    union = " UNION ALL ".join(f"SELECT * FROM {prefix}a{i}" for i in range(rounds))
    out[f"{prefix}acc"] = f"SELECT *, src_len - ol_len AS prefix_len, dst_len - ol_len AS prefix_len_rev FROM ({union})"
    return out


def _hops(prefix: str, ends: str, hops: int = 3) -> dict[str, str]:
    out = {f"{prefix}f1": f"SELECT first AS read_id FROM {ends} UNION SELECT last FROM {ends}"}
    rows = f"{prefix}acc"
    for h in range(1, hops + 1):
        flag, f = f"{prefix}h{h}", f"{prefix}f{h}"
        out[flag] = f"""SELECT r.* EXCLUDE (ln), ln, {h} AS hop, src_read IN (SELECT read_id FROM {f}) AS sk, dst_read IN (SELECT read_id FROM {f}) AS dk
         FROM {rows} r WHERE (SELECT count(*) FROM {rows}) > 0.01 * (SELECT count(*) FROM {prefix}acc)"""
        out[f"{prefix}r{h}"] = f"SELECT * EXCLUDE (hop, sk, dk) FROM {flag} WHERE NOT sk AND NOT dk"
        out[f"{prefix}f{h + 1}"] = f"SELECT read_id FROM {f} UNION SELECT CASE WHEN sk THEN dst_read ELSE src_read END FROM {flag} WHERE sk <> dk"
        rows = f"{prefix}r{h}"
    every = " UNION ALL ".join(f"SELECT * FROM {prefix}h{h}" for h in range(1, hops + 1))
    out[f"{prefix}flag"] = every
    out[f"{prefix}ge"] = f"""SELECT hop, src_read, src_orient, dst_read, dst_orient, ol_len, prefix_len FROM {prefix}flag WHERE sk AND dk
     UNION ALL SELECT hop, dst_read, {_flip('dst_orient')}, src_read, {_flip('src_orient')}, ol_len, prefix_len_rev FROM {prefix}flag WHERE sk AND dk"""
    out[f"{prefix}ga"] = f"""SELECT hop, src_orient AS orient, src_read AS read_id, src_len AS read_len, 'out' AS dir, dst_read AS nbr_read, dst_orient AS nbr_orient, ol_len, prefix_len FROM {prefix}flag WHERE NOT sk AND dk
     UNION ALL SELECT hop, {_flip('src_orient')}, src_read, src_len, 'in', dst_read, {_flip('dst_orient')}, ol_len, prefix_len_rev FROM {prefix}flag WHERE NOT sk AND dk
     UNION ALL SELECT hop, dst_orient, dst_read, dst_len, 'in', src_read, src_orient, ol_len, prefix_len FROM {prefix}flag WHERE sk AND NOT dk
     UNION ALL SELECT hop, {_flip('dst_orient')}, dst_read, dst_len, 'out', src_read, {_flip('src_orient')}, ol_len, prefix_len_rev FROM {prefix}flag WHERE sk AND NOT dk"""
    return out


CTES.update(_accepted("raw", "rawends", "rawread", "rawedges"))
CTES.update(_accepted("con", "cends", "cread", "cedges"))
CTES.update(_hops("raw", "rawends"))
CTES.update(_hops("con", "cends"))


# --------------------------------------------------------------------------- k-mers
def _kmers(k: int) -> dict[str, str]:
    return {
        f"chunk{k}": f"""SELECT read_id, c AS base, substr(seq, c::INT + 1, {1000 + k - 1}) AS t FROM (
          SELECT read_id, seq, unnest(range(0, read_len, 1000)) AS c FROM reads WHERE read_len >= {k})""",
        f"occ{k}": f"""SELECT read_id, p, least(w, {_rc('w')}) AS w FROM (SELECT read_id, base + j AS p, substr(t, j::INT + 1, {k}) AS w FROM (
          SELECT read_id, base, t, unnest(range(0, least(1000, length(t) - {k - 1}))) AS j FROM chunk{k}))""",
        f"kmers{k}": f"SELECT w, count(*) AS freq FROM occ{k} GROUP BY w",
    }


CTES.update(_kmers(9))
CTES.update(_kmers(K))
CTES["histo"] = f"SELECT freq, count(*) AS n FROM kmers{K} GROUP BY freq"
CTES["kept"] = f"SELECT freq, n FROM histo WHERE freq <= (SELECT quantile_cont(freq, 0.995) FROM kmers{K})"
CTES["axis"] = "SELECT f AS freq, coalesce(n, 0) AS n FROM (SELECT unnest(range(1, (SELECT max(freq) + 1 FROM kept))) AS f) LEFT JOIN kept ON kept.freq = f"
CTES["minima"] = """SELECT freq FROM (SELECT freq, n, lag(n) OVER (ORDER BY freq) AS p, lead(n) OVER (ORDER BY freq) AS q FROM axis) WHERE n < p AND n < q"""
CTES["avgf"] = "SELECT sum(freq * n) / sum(n) AS average FROM kept WHERE freq > (SELECT min(freq) FROM minima)"
CTES["bounds"] = f"""SELECT (SELECT quantile_cont(freq, 0.995) FROM kmers{K})::DOUBLE AS cutoff, average::DOUBLE AS average, nearest, (SELECT min(freq) FROM minima) AS lower,
 coalesce((SELECT min(freq) FROM minima WHERE freq > nearest), (SELECT max(freq) FROM kept)) AS upper
 FROM avgf, (SELECT arg_min(freq, (abs(freq - (SELECT average FROM avgf)), freq)) AS nearest FROM kept)"""
CTES["solid"] = f"SELECT w, freq FROM kmers{K}, bounds WHERE freq BETWEEN lower AND upper"
CTES["wfreq"] = f"SELECT read_id, p, freq FROM occ{K} LEFT JOIN solid USING (w)"

# ------------------------------------------------------------------------ telomeres
M = len(MOTIFS[0])


def _rotations(motif: str) -> str:
    return "(" + ", ".join(f"'{motif[i:] + motif[:i]}'" for i in range(len(motif))) + ")"


_PAIR = str.maketrans("ACGT", "TGCA")
CTES["tpos"] = f"""SELECT walk_id, n, base + j AS pt, substr(t, j::INT + 1, {M}) AS w FROM (
 SELECT walk_id, n, base, t, unnest(range(0, least(1000, length(t) - {M - 1}))) AS j FROM (
 SELECT walk_id, n, c AS base, substr(seq, c::INT + 1, {1000 + M - 1}) AS t FROM (
 SELECT walk_id, seq, length(seq) AS n, unnest(range(0, length(seq), 1000)) AS c FROM ctext)))"""
CTES["tside"] = " UNION ALL ".join(
    f"SELECT walk_id, n, {no} AS motif_no, '{side}' AS side, {step} AS step, CASE WHEN w IN {_rotations(m)} THEN 1 ELSE {-PENALTY} END AS v FROM tpos"
    for no, motif in enumerate(MOTIFS)
    for side, m, step in (("start", motif, "pt"), ("end", motif[::-1].translate(_PAIR), f"n - {M} - pt"))
)
CTES["tscore"] = "SELECT *, sum(v) OVER (PARTITION BY walk_id, motif_no, side ORDER BY step) AS score FROM tside"
CTES["tbest"] = """SELECT *, greatest(0, max(score) OVER (PARTITION BY walk_id, motif_no, side ORDER BY step)) AS best FROM tscore"""
CTES["tlive"] = f"""SELECT b.* FROM tbest b LEFT JOIN (SELECT walk_id, motif_no, side, min(step) AS stop FROM tbest WHERE best - score > {MAX_DROP} GROUP BY ALL) s
 ON s.walk_id = b.walk_id AND s.motif_no = b.motif_no AND s.side = b.side WHERE stop IS NULL OR step < stop"""
CTES["regions"] = f"""SELECT walk_id, motif_no, side, CASE WHEN side = 'start' THEN 0 ELSE n - step - {M} END AS "start",
 CASE WHEN side = 'start' THEN step + {M} ELSE n END AS "end" FROM (
 SELECT walk_id, motif_no, side, any_value(n) AS n, max(score) AS top, arg_max(step, (score, -step)) AS step FROM tlive GROUP BY walk_id, motif_no, side)
 WHERE top >= {MIN_SCORE}"""
CTES["typed"] = f"""SELECT *, CASE WHEN c1 > c2 THEN '+' ELSE '-' END AS motif FROM (
 SELECT r.*, (SELECT count(*) FROM tpos p WHERE p.walk_id = r.walk_id AND p.w = '{MOTIFS[0]}' AND p.pt >= r."start" AND p.pt + {M} <= r."end" - 1) AS c1,
  (SELECT count(*) FROM tpos p WHERE p.walk_id = r.walk_id AND p.w = '{MOTIFS[1]}' AND p.pt >= r."start" AND p.pt + {M} <= r."end" - 1) AS c2 FROM regions r)"""
CTES["tnodes"] = """SELECT walk_id, start_node, arg_min(end_node, o) AS end_node, arg_min(motif, o) AS motif FROM (
 SELECT t.walk_id, motif, (motif_no, side <> 'start') AS o, a.node_id AS start_node, b.node_id AS end_node FROM typed t
 JOIN cpieces a ON a.walk_id = t.walk_id AND t."start" >= a."offset" AND t."start" < a."offset" + a.piece_len
 JOIN cpieces b ON b.walk_id = t.walk_id AND t."end" - 1 >= b."offset" AND t."end" - 1 < b."offset" + b.piece_len) GROUP BY walk_id, start_node"""

CTES["tev"] = """SELECT *, row_number() OVER (PARTITION BY walk_id ORDER BY lo) AS rn FROM (
 SELECT s.walk_id, s.pos AS lo, t.motif, min(e.pos) AS hi FROM tnodes t JOIN cpieces s ON s.walk_id = t.walk_id AND s.node_id = t.start_node
 JOIN cpieces e ON e.walk_id = t.walk_id AND e.node_id = t.end_node AND e.pos >= s.pos GROUP BY s.walk_id, s.pos, t.motif)"""
CTES["tsize"] = "SELECT walk_id, count(*) AS n FROM cpieces GROUP BY walk_id"
# one state row per walk and event: where the open piece begins, its motif, what was emitted
CTES["tstate"] = """SELECT * FROM (WITH RECURSIVE st(walk_id, rn, bg, opened, done, plo, phi, ps, pe) AS (
 SELECT walk_id, 0::BIGINT, 0::BIGINT, NULL::VARCHAR, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR FROM tsize
 UNION ALL SELECT walk_id, rn, CASE act WHEN 1 THEN hi + 1 WHEN 3 THEN lo WHEN 4 THEN hi + 1 ELSE bg END,
  CASE act WHEN 0 THEN opened WHEN 2 THEN motif WHEN 3 THEN motif END, CASE act WHEN 0 THEN done ELSE hi + 1 END,
  CASE WHEN act IN (1, 3, 4) THEN bg END, CASE act WHEN 1 THEN hi WHEN 3 THEN lo - 1 WHEN 4 THEN hi END,
  CASE WHEN act IN (3, 4) THEN opened END, CASE WHEN act IN (1, 4) THEN motif END FROM (
  SELECT st.walk_id, e.rn, bg, opened, done, lo, hi, motif, CASE WHEN lo < done THEN 0 WHEN opened IS NULL AND lo > bg THEN 1
   WHEN opened IS NULL THEN 2 WHEN opened = motif THEN 3 ELSE 4 END AS act FROM st JOIN tev e ON e.walk_id = st.walk_id AND e.rn = st.rn + 1))
 SELECT * FROM st)"""
CTES["tpieces"] = """SELECT row_number() OVER (ORDER BY old, lo) - 1 AS walk_id, old, lo, hi, ps, pe FROM (
 SELECT walk_id AS old, plo AS lo, phi AS hi, ps, pe FROM tstate WHERE plo IS NOT NULL UNION ALL
 SELECT s.walk_id, bg, n - 1, opened, NULL FROM (SELECT walk_id, arg_max(bg, rn) AS bg, arg_max(CASE WHEN opened IS NULL THEN '' ELSE opened END, rn) AS op FROM tstate GROUP BY walk_id) q
 JOIN tsize s ON s.walk_id = q.walk_id, LATERAL (SELECT nullif(op, '') AS opened) WHERE bg < n)"""

# --------------------------------------------------------------- scaffold, unchopped
CTES["cends2"] = """SELECT walk_id, pos, node_id, pos < cutoff AS at_start, pos >= n - cutoff AS at_end FROM (
 SELECT contig_no AS walk_id, pos, node_id, n, greatest(1, floor(n / (1 / 0.01::DOUBLE)))::BIGINT AS cutoff FROM (
 SELECT contig_no, pos, node_id, count(*) OVER (PARTITION BY contig_no) AS n FROM cplaced)) WHERE pos < cutoff OR pos >= n - cutoff"""
CTES["near"] = f"""SELECT DISTINCT g.orient, g.read_id, dir, e.walk_id, g.node_id, prefix_len, ol_len FROM (
 SELECT orient, a.read_id, dir, {_node('real_id', 'nbr_orient')} AS node_id, prefix_len, ol_len FROM conga a JOIN cread c ON c.read_id = nbr_read WHERE hop = 1) g
 JOIN cends2 e ON e.node_id = g.node_id AND CASE WHEN dir = 'out' THEN at_start ELSE at_end END"""
CTES["ghosts"] = """SELECT orient, read_id, (SELECT count(DISTINCT contig_no) FROM cplaced) + row_number() OVER (ORDER BY orient, read_id) - 1 AS ghost FROM (
 SELECT orient, read_id FROM near GROUP BY ALL HAVING count(*) FILTER (dir = 'in') > 0 AND count(*) FILTER (dir = 'out') > 0 AND min(walk_id) < max(walk_id))"""
CTES["gedges"] = """SELECT CASE WHEN dir = 'out' THEN ghost ELSE walk_id END AS new_src, CASE WHEN dir = 'out' THEN walk_id ELSE ghost END AS new_dst,
 CASE WHEN dir = 'in' THEN node_id END AS old_src, CASE WHEN dir = 'out' THEN node_id END AS old_dst, prefix_len, ol_len
 FROM near JOIN ghosts USING (orient, read_id)"""
CTES["inner_e"] = f"""SELECT s.walk_id AS new_src, d.walk_id AS new_dst, s.node_id AS old_src, d.node_id AS old_dst, prefix_len, ol_len FROM conge g
 JOIN cread a ON a.read_id = src_read JOIN cread b ON b.read_id = dst_read
 JOIN cends2 s ON s.at_end AND s.node_id = {_node('a.real_id', 'src_orient')} JOIN cends2 d ON d.at_start AND d.node_id = {_node('b.real_id', 'dst_orient')}
 WHERE src_read <> dst_read AND s.walk_id <> d.walk_id"""
CTES["sedges"] = "SELECT * FROM gedges UNION ALL SELECT * FROM inner_e"


def _range(name: str, lo: str, hi: str) -> str:
    """(sum, hits) of window frequencies as one correlated scan."""
    return f"""(SELECT (coalesce(sum(freq), 0)::BIGINT, count(freq)) FROM wfreq w WHERE w.read_id = {name} AND w.p >= {lo} AND w.p < {hi})"""


CTES["glen"] = "SELECT read_id, max(read_len) AS n FROM conga GROUP BY read_id"
CTES["repreq"] = f"""SELECT ghost, side, read_id, CASE WHEN orient = '+' THEN lo ELSE n - {K} + 1 - hi END AS lo, CASE WHEN orient = '+' THEN hi ELSE n - {K} + 1 - lo END AS hi FROM (
 SELECT ghost, side, read_id, orient, n, lo, greatest(upto - {K} + 1, lo) AS hi FROM (
 SELECT g.ghost, 'pre' AS side, g.read_id, orient, n, 0 AS lo, least(a, n) AS upto FROM (SELECT new_dst AS ghost, sum(ol_len)::BIGINT // count(*) AS a FROM sedges GROUP BY new_dst) JOIN ghosts g USING (ghost) JOIN glen USING (read_id)
 UNION ALL SELECT g.ghost, 'suf', g.read_id, orient, n, CASE WHEN a = 0 THEN 0 ELSE n - least(a, n) END, n FROM (SELECT new_src AS ghost, sum(ol_len)::BIGINT // count(*) AS a FROM sedges GROUP BY new_src) JOIN ghosts g USING (ghost) JOIN glen USING (read_id)))"""
CTES["rephit"] = """SELECT ghost, side, greatest(any_value(hi) - any_value(lo), 1) AS total, count(freq) AS hits FROM repreq r
 LEFT JOIN wfreq w ON w.read_id = r.read_id AND w.p >= r.lo AND w.p < r.hi GROUP BY ghost, side"""
CTES["rep"] = "SELECT DISTINCT ghost FROM rephit WHERE total - hits >= 0.8 * total"
CTES["fedges"] = "SELECT * FROM sedges WHERE new_src NOT IN (SELECT ghost FROM rep) AND new_dst NOT IN (SELECT ghost FROM rep)"
CTES["cat_"] = "SELECT contig_no AS walk_id, node_id, min(pos) AS lo, max(pos) AS hi FROM cplaced GROUP BY ALL"
CTES["oneedge"] = """SELECT new_src, new_dst, old_src, old_dst, prefix_len, ol_len FROM (SELECT f.*, row_number() OVER (PARTITION BY new_src, new_dst ORDER BY
 coalesce(a.hi, 0) - coalesce(b.lo, 0) DESC, ol_len DESC, prefix_len, coalesce(old_src, 0), coalesce(old_dst, 0)) AS rn FROM fedges f
 LEFT JOIN cat_ a ON a.walk_id = new_src AND a.node_id = old_src LEFT JOIN cat_ b ON b.walk_id = new_dst AND b.node_id = old_dst) WHERE rn = 1"""
CTES["sided"] = """SELECT e.*, coalesce(gs.read_id, ns.name) AS sn, coalesce(gs.orient, ns.orient) AS so, coalesce(ls.n, ns.read_len) AS sl,
 coalesce(gd.read_id, nd.name) AS dn, coalesce(gd.orient, nd.orient) AS dor, coalesce(ld.n, nd.read_len) AS dl FROM oneedge e
 LEFT JOIN ghosts gs ON gs.ghost = new_src LEFT JOIN glen ls ON ls.read_id = gs.read_id LEFT JOIN cnodes ns ON ns.node_id = old_src
 LEFT JOIN ghosts gd ON gd.ghost = new_dst LEFT JOIN glen ld ON ld.read_id = gd.read_id LEFT JOIN cnodes nd ON nd.node_id = old_dst"""
_SLOTS = {
    "f1": ("sn", "so", "sl", True), "f2": ("dn", "dor", "dl", False), "r1": ("dn", "dor", "dl", True), "r2": ("sn", "so", "sl", False),
}
CTES["covreq"] = " UNION ALL ".join(
    f"""SELECT new_src, new_dst, '{slot}' AS slot, {name} AS read_id,
 CASE WHEN {o} = '+' THEN lo ELSE {n} - {K} + 1 - greatest(lo, hi) END AS lo, CASE WHEN {o} = '+' THEN greatest(lo, hi) ELSE {n} - {K} + 1 - lo END AS hi
 FROM (SELECT *, {'0' if head else 'ol_len'} AS lo, {f'CASE WHEN ol_len = 0 THEN 0 ELSE {n} - ol_len - {K} + 1 END' if head else f'{n} - {K} + 1'} AS hi FROM sided)"""
    for slot, (name, o, n, head) in _SLOTS.items()
)
CTES["covval"] = """SELECT new_src, new_dst, slot, CASE WHEN greatest(any_value(hi) - any_value(lo), 1) - count(freq) >= 0.8 * greatest(any_value(hi) - any_value(lo), 1)
 THEN -99999 ELSE sum(freq) / count(freq) END AS c FROM covreq r LEFT JOIN wfreq w ON w.read_id = r.read_id AND w.p >= r.lo AND w.p < r.hi GROUP BY new_src, new_dst, slot"""


# ------------------------------------------------------------ two hops and look-ahead
# hops that start at the contigs' first reads only, so that there are ghosts of ghosts
CTES["fends"] = "SELECT name AS first, name AS last FROM cplaced WHERE pos = 0"
CTES["faracc"] = "SELECT * FROM conacc"
CTES.update(_hops("far", "fends"))
CTES["fnear"] = CTES["near"].replace("conga", "farga")
CTES["finner"] = CTES["inner_e"].replace("conge", "farge")
CTES["g1"] = """SELECT orient, read_id, (SELECT count(DISTINCT contig_no) FROM cplaced) + row_number() OVER (ORDER BY orient, read_id) - 1 AS ghost
 FROM (SELECT DISTINCT orient, read_id FROM farga WHERE hop = 1)"""
CTES["n2"] = """SELECT DISTINCT a.orient, a.read_id, a.dir, g.ghost, a.prefix_len, a.ol_len FROM farga a
 JOIN g1 g ON g.read_id = nbr_read AND g.orient = nbr_orient WHERE hop = 2"""
CTES["ok2"] = "SELECT orient, read_id FROM n2 GROUP BY ALL HAVING count(*) FILTER (dir = 'in') > 0 AND count(*) FILTER (dir = 'out') > 0"
CTES["g2"] = """SELECT orient, read_id, (SELECT count(DISTINCT contig_no) FROM cplaced) + (SELECT count(*) FROM g1) + row_number() OVER (ORDER BY orient, read_id) - 1 AS ghost FROM ok2"""
CTES["gall"] = "SELECT * FROM g1 UNION ALL SELECT * FROM g2"
CTES["outer_e"] = """SELECT s.ghost AS new_src, d.ghost AS new_dst, NULL::BIGINT AS old_src, NULL::BIGINT AS old_dst, prefix_len, ol_len FROM farge
 LEFT JOIN cread a ON a.read_id = src_read LEFT JOIN cread b ON b.read_id = dst_read
 JOIN gall s ON s.read_id = src_read AND s.orient = src_orient JOIN gall d ON d.read_id = dst_read AND d.orient = dst_orient
 WHERE src_read <> dst_read AND (a.real_id IS NULL OR b.real_id IS NULL)"""
CTES["wide_e"] = """SELECT CASE WHEN dir = 'out' THEN ghost ELSE walk_id END AS new_src, CASE WHEN dir = 'out' THEN walk_id ELSE ghost END AS new_dst,
 CASE WHEN dir = 'in' THEN node_id END AS old_src, CASE WHEN dir = 'out' THEN node_id END AS old_dst, prefix_len, ol_len FROM fnear JOIN g1 USING (orient, read_id)
 UNION ALL SELECT CASE WHEN dir = 'out' THEN g2.ghost ELSE n2.ghost END, CASE WHEN dir = 'out' THEN n2.ghost ELSE g2.ghost END, NULL, NULL, prefix_len, ol_len FROM n2 JOIN g2 USING (orient, read_id)
 UNION ALL SELECT * FROM finner UNION ALL SELECT * FROM outer_e"""
CTES["gends"] = f"""SELECT DISTINCT walk_id, node_id FROM (SELECT new_src AS walk_id, old_src AS node_id FROM oneedge WHERE old_src IS NOT NULL AND old_dst IS NULL
 UNION ALL SELECT new_dst, old_dst FROM oneedge WHERE old_dst IS NOT NULL AND old_src IS NULL)"""
CTES["cor"] = f"SELECT node_id, CASE WHEN orient = '+' THEN seq ELSE {_rc('seq')} END AS text FROM cnodes JOIN cseqs USING (name)"
CTES["flank"] = """SELECT walk_id, node_id, CASE WHEN nxt IS NULL THEN joined ELSE substr(joined, 1, to_next::INT) || nxt END AS seq FROM (
 SELECT e.walk_id, e.node_id, coalesce(substr(tp.text, 1, p.prefix_len::INT), '') || tc.text AS joined, c.prefix_len AS to_next, tn.text AS nxt
 FROM (SELECT walk_id, e.node_id, min(pos) AS pos FROM gends e JOIN csteps s USING (walk_id, node_id) GROUP BY ALL) e
 JOIN csteps c ON c.walk_id = e.walk_id AND c.pos = e.pos JOIN cor tc ON tc.node_id = c.node_id
 LEFT JOIN csteps p ON p.walk_id = e.walk_id AND p.pos = e.pos - 1 LEFT JOIN cor tp ON tp.node_id = p.node_id
 LEFT JOIN cor tn ON tn.node_id = c.next_node)"""
CTES["flankcov"] = f"""SELECT walk_id, node_id, CASE WHEN count(*) - count(freq) > 0.8 * count(*) OR count(freq) = 0 THEN -99999.0 ELSE sum(freq) / count(freq) END AS cov FROM (
 SELECT walk_id, node_id, freq FROM (SELECT walk_id, node_id, least(w, {_rc('w')}) AS w FROM (SELECT walk_id, node_id, substr(seq, j::INT + 1, {K}) AS w FROM (
 SELECT walk_id, node_id, seq, unnest(range(0, greatest(length(seq) - {K - 1}, 1))) AS j FROM flank)))
 LEFT JOIN (SELECT s.w, s.freq FROM solid s, bounds b WHERE s.freq > b.lower AND s.freq < b.upper) USING (w)) GROUP BY ALL"""
CTES["gsteps"] = """SELECT *, (a = -99999 AND b = -99999) OR cov_diff <= 0.3 * greatest(a, b) AS ok FROM (
 SELECT s.new_src AS src, s.new_dst AS ghost, d.new_dst AS dst, a.cov::DOUBLE AS a, b.cov::DOUBLE AS b, abs(a.cov - b.cov)::DOUBLE AS cov_diff, a.cov = -99999 OR b.cov = -99999 AS invalid
 FROM oneedge s JOIN oneedge d ON d.new_src = s.new_dst AND s.old_dst IS NULL AND d.old_src IS NULL AND s.old_src IS NOT NULL AND d.old_dst IS NOT NULL AND s.new_src <> d.new_dst
 JOIN flankcov a ON a.walk_id = s.new_src AND a.node_id = s.old_src JOIN flankcov b ON b.walk_id = d.new_dst AND b.node_id = d.old_dst)"""


def _needs(sql: str) -> list[str]:
    import re

    found: list[str] = []
    words = set(re.findall(r"[a-z_0-9]+", sql))
    for name, body in CTES.items():
        if name in words and re.search(rf"(?:FROM|JOIN)\s*(?:\(\s*)*{name}\b|,\s*{name}\b", sql):
            found.append(name)
    return found


def with_ctes(sql: str) -> str:
    """Prefix the statement with the CTEs it needs, in definition order."""
    needed: set[str] = set()
    todo = _needs(sql)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += _needs(CTES[name])
    order = _topological(needed)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order) + "\n" + sql


def _topological(names: set[str]) -> list[str]:
    done: list[str] = []

    def visit(name: str) -> None:
        if name not in done:
            for other in _needs(CTES[name]):
                if other != name:
                    visit(other)
            done.append(name)

    for name in CTES:
        if name in names:
            visit(name)
    return done
