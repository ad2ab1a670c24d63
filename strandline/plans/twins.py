"""SQL of queries whose rows depend on the rows before them: recursive tables that walk each stream in its order, and sums of
merges for the size of Huffman codes."""

from __future__ import annotations

from .codecs import NOTES, SKIPS
from .registry import SQL
from .streams import RUNS
from .tiles import DIST


def huffman_bits(frequencies: str, name: str) -> str:
    """Tables {name}_m and {name} (bits): the total of a Huffman code for a table of frequencies (n). Merging the two least
    weights adds their sum, until one is left; a single symbol takes no bits."""
    return f"""{name}_m AS (SELECT list_sort(list(n)) AS w, 0::BIGINT AS bits FROM ({frequencies}) UNION ALL
        SELECT list_sort(list_append(w[3:], w[1] + w[2])), (bits + w[1] + w[2])::BIGINT FROM {name}_m WHERE len(w) > 1),
    {name} AS (SELECT max(bits) AS bits FROM {name}_m)"""


SQL["streaming_runs"] = """WITH c AS (SELECT user_id AS cell, ts, event_id, event_type AS symbol, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS new FROM events),
    g AS (SELECT *, sum(new) OVER (PARTITION BY cell ORDER BY ts, event_id) AS run FROM c),
    r AS (SELECT cell, run, min(symbol) AS symbol, min(ts) AS start_ts, count(*) AS run_len FROM g GROUP BY cell, run)
    SELECT cell, symbol, start_ts, run_len FROM r QUALIFY run < max(run) OVER (PARTITION BY cell)"""
SQL["streaming_tumbling"] = "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, round(sum(value), 6) AS bits, count(*) AS n FROM events GROUP BY ALL"
SQL["note_xml"] = f"SELECT conv_id, turn, '<note><note>' || note || '</note><len>' || len || '</len><run>' || run || '</run></note>' || chr(10) AS xml FROM {NOTES}"
SQL["history_references"] = f"""WITH {RUNS}, k AS (SELECT cell, run, to_sym, lag(run) OVER (PARTITION BY cell, to_sym ORDER BY run) AS last FROM chg),
    d AS (SELECT a.cell, a.run, a.last, count(DISTINCT b.to_sym) AS between FROM k a LEFT JOIN k b ON a.cell = b.cell AND b.run > a.last AND b.run < a.run GROUP BY ALL)
    SELECT cell, run, CAST(CASE WHEN last IS NULL OR between >= 14 THEN -1 ELSE between END AS INTEGER) AS back FROM d"""
SQL["smoothed_bits"] = """WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    s AS (SELECT user_id, event_id, k, value AS smooth FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, s.smooth * 0.9 + e.value * 0.1 FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
    SELECT event_id, round(smooth, 6) AS smooth FROM s"""
SQL["motion_suppressed"] = """WITH RECURSIVE e AS (SELECT user_id, event_id, coalesce(value, 0.0) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    s AS (SELECT user_id, event_id, k, v AS shown, 0.0::DOUBLE AS built FROM e WHERE k = 1 UNION ALL
        SELECT e.user_id, e.event_id, e.k, CASE WHEN abs(v - shown) + built + sqrt(abs(v - shown)) >= 20 THEN v ELSE shown END, CASE WHEN abs(v - shown) + built + sqrt(abs(v - shown)) >= 20 THEN 0.0 ELSE built + sqrt(abs(v - shown)) END
        FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
    SELECT event_id, shown FROM s"""
SQL["voice_schedule"] = f"""WITH RECURSIVE n AS (SELECT conv_id, turn, greatest(1, len) AS len, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM {NOTES}),
    s AS (SELECT conv_id, 0::BIGINT AS k, NULL::BIGINT AS turn, NULL::INTEGER AS voice, [0, 0, 0, 0]::BIGINT[] AS u FROM n WHERE k = 1 UNION ALL
        SELECT conv_id, k, turn, voice, list_transform(u, lambda x, i: CASE WHEN i = voice + 1 THEN turn * 4 + len ELSE x END) FROM
            (SELECT n.conv_id, n.k, n.turn, n.len, s.u, (CASE WHEN u[1] <= n.turn * 4 THEN 0 WHEN u[2] <= n.turn * 4 THEN 1 WHEN u[3] <= n.turn * 4 THEN 2 WHEN u[4] <= n.turn * 4 THEN 3 ELSE -1 END)::INTEGER AS voice FROM s JOIN n ON n.conv_id = s.conv_id AND n.k = s.k + 1))
    SELECT conv_id, turn, voice FROM s WHERE k > 0"""
SQL["skips_applied"] = f"""WITH RECURSIVE {SKIPS.removeprefix("WITH ")}, o AS (SELECT *, least(late_impact, early_impact) AS cost, row_number() OVER (PARTITION BY cell ORDER BY least(late_impact, early_impact), run) AS i FROM k),
    t AS (SELECT cell, 0::BIGINT AS i, NULL::BIGINT AS run, NULL::BIGINT AS on_pos, NULL::DOUBLE AS cost, false AS taken, 0.0::DOUBLE AS spent, []::STRUCT(a BIGINT, b BIGINT)[] AS spans FROM o WHERE i = 1 UNION ALL
        SELECT cell, i, run, on_pos, cost, fits, CASE WHEN fits THEN spent + cost ELSE spent END, CASE WHEN fits THEN list_append(spans, {{'a': prev_change, 'b': next_change}}) ELSE spans END FROM
            (SELECT o.cell, o.i, o.run, o.on_pos, o.cost, t.spent, t.spans, o.prev_change, o.next_change,
                t.spent + o.cost <= 500 AND len(list_filter(t.spans, lambda s: o.next_change > s.a AND s.b > o.prev_change)) = 0 AS fits FROM t JOIN o ON o.cell = t.cell AND o.i = t.i + 1))
    SELECT cell, run, on_pos, cost FROM t WHERE taken"""
_KEPT = """WITH RECURSIVE m AS (SELECT array_to_string(list_transform(embedding, lambda v: CASE WHEN v > 0 THEN '1' ELSE '0' END), '') AS mask, min(vec_id) AS id, count(*) AS n FROM embeddings GROUP BY 1),
    o AS (SELECT *, row_number() OVER (ORDER BY {order}) AS k FROM m),
    t AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS id, NULL::BIGINT AS n, NULL::BIGINT AS kept, []::STRUCT(id BIGINT, mask VARCHAR)[] AS seen UNION ALL
        SELECT k, id, n, coalesce(hit, id), CASE WHEN hit IS NULL THEN list_append(seen, {{'id': id, 'mask': mask}}) ELSE seen END FROM
            (SELECT o.k, o.id, o.n, o.mask, t.seen, list_filter(t.seen, lambda s: hamming(s.mask, o.mask) < {cutoff})[1].id AS hit FROM t JOIN o ON o.k = t.k + 1))
    {select}"""
SQL["first_match_reuse"] = _KEPT.format(order="id", cutoff=4, select="SELECT id, kept FROM t WHERE k > 0")
SQL["hamming_prune_greedy"] = _KEPT.format(order="n DESC, id", cutoff=3, select="SELECT id, n FROM t WHERE k > 0 AND id = kept")
SQL["huffman_size"] = f"""WITH RECURSIVE f AS (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c), {huffman_bits("SELECT n FROM f", "h")}
    SELECT count(*) AS n_symbols, sum(n)::BIGINT AS n, (SELECT bits FROM h) AS bits, round(sum(-log2(n / total) * n), 3) AS entropy FROM f, (SELECT sum(n) AS total FROM f)"""
SQL["note_huffman"] = "WITH RECURSIVE x AS (SELECT * FROM " + NOTES + "), " + ", ".join(
    huffman_bits(f"SELECT count(*) AS n FROM x GROUP BY {by}", name) for name, by in (("whole", "note, len, run"), ("a", "note"), ("bc", "len, run"), ("b", "len"), ("c", "run"))
) + """ SELECT 1 AS tables, whole.bits AS bits FROM whole UNION ALL SELECT 2, a.bits + bc.bits FROM a, bc UNION ALL SELECT 3, a.bits + b.bits + c.bits FROM a, b, c"""
SQL["two_tree_size"] = f"""WITH RECURSIVE {RUNS}, {huffman_bits("SELECT count(*) AS n FROM runs GROUP BY symbol", "a")}, {huffman_bits("SELECT count(*) AS n FROM runs GROUP BY run_len", "b")},
    {huffman_bits("SELECT count(*) AS n FROM runs GROUP BY symbol UNION ALL SELECT count(*) FROM runs GROUP BY run_len", "u")}
    SELECT 'separate' AS layout, a.bits + b.bits AS bits FROM a, b UNION ALL SELECT 'unified', u.bits FROM u"""
SQL["coder_sizes"] = f"""WITH RECURSIVE {DIST}, a AS (SELECT vec_id, code FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, code) = 1), f AS (SELECT code, count(*) AS n FROM a GROUP BY code), {huffman_bits("SELECT n FROM f", "h")}
    SELECT 'entropy' AS coder, round(sum(-log2(n / total) * n), 3) AS bits FROM f, (SELECT sum(n) AS total FROM f) UNION ALL SELECT 'huffman', bits::DOUBLE FROM h
    UNION ALL SELECT 'plain', (greatest(1, ceil(log2(count(*)))) * sum(n))::DOUBLE FROM f"""
