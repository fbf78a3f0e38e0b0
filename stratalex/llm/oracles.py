"""DuckDB SQL of the corpus queries that SQL can express, written apart from the operators."""

from __future__ import annotations

from stratalex.llm.chat import ESCAPE, Template


def _escaped(x: str, template: Template) -> str:
    x = f"replace({x}, '{ESCAPE}', '{ESCAPE * 2}')"
    for c in template.controls:
        x = f"replace({x}, '{c}', '{c[0] + ESCAPE + c[1:]}')"
    return x


def chat_format(said: str) -> str:
    """Turns, loss and lengths of all conversations and conversation -7; the order of roles as a pattern of letters."""
    t = Template()
    marks = " ".join(f"WHEN '{role}' THEN {len(o) + len(c)}" for role, (o, c) in t.marks.items())
    other = f"{len(t.other[0].format('')) + len(t.other[1])} + length(replace({_escaped('role', t)}, '>', '>{ESCAPE}'))"
    return f"""WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{said}' UNION ALL SELECT -7, 1, 'assistant', '{said}'
), r AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
         coalesce(role, '') AS role, coalesce(text, '') AS text FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_escaped('text', t)}) + CASE role {marks} ELSE {other} END) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY k), 's?(ua)+') AS valid
FROM r GROUP BY conv_id"""


#: Windows as joined words (a word holds no space); a word goes if one of the 13 windows that may cover it recurs.
PHRASE_DEDUP = r"""WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS win
  FROM d WHERE len(w) >= 13
), f AS (
  SELECT doc_id, p, CAST(min(doc_id) OVER (PARTITION BY win) < doc_id AS INT) AS again FROM t
), v AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), g AS (
  SELECT v.doc_id, v.p, word, coalesce(max(again) OVER (PARTITION BY v.doc_id ORDER BY v.p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM v LEFT JOIN f ON f.doc_id = v.doc_id AND f.p = v.p
), h AS (
  SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone = 0) AS kept FROM g GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN h ON h.doc_id = d.doc_id"""


#: Ranks and forms from the hex digest of the id; parts by code points.
FILL_MIDDLE = r"""WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), k AS (
  SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS r1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS r2,
         CAST('0x' || h[17:24] AS BIGINT) % 100 AS r3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS r4 FROM d
), f AS (
  SELECT doc_id, t, n, least(r1, r2) AS a, greatest(r1, r2) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r3 >= 90 THEN 'plain' WHEN r4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k
), p AS (
  SELECT doc_id, t, n, a, b, form, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p"""


#: One pattern for all layouts; offsets of a zone a day before and after tell of a change between.
STAMPS = r"""WITH s AS (
  SELECT stamp_id, source, zone, regexp_replace(coalesce(raw, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS r FROM stamps
), x AS (
  SELECT stamp_id, source, zone, r, regexp_extract(r, '^(?:(20\d\d)-(\d\d)-(\d\d)|(20\d\d)(\d\d)(\d\d)|(\d\d)\.(\d\d)\.(20\d\d)|(\d\d) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) (20\d\d)|(\d\d)/(\d\d)/(20\d\d))(?:[T ](\d\d):(\d\d)(?::(\d\d))?(?: ?([AP])M)?(?: ?(?:(Z)|([+-])(\d\d):?(\d\d)))?)?$',
    ['y1','m1','d1','y2','m2','d2','d3','m3','y3','d4','b4','y4','a5','b5','y5','h','mi','se','half','z','sign','oh','om']) AS g FROM s
), f AS (
  SELECT stamp_id, source, zone, r, g.a5 <> '' AS slashed, g.y1 || g.y2 || g.y3 || g.y4 || g.y5 AS y,
    CASE WHEN g.b4 <> '' THEN CAST((position(g.b4 IN 'JanFebMarAprMayJunJulAugSepOctNovDec') + 2) // 3 AS VARCHAR) ELSE g.m1 || g.m2 || g.m3 || g.b5 END AS m, g.d1 || g.d2 || g.d3 || g.d4 || g.a5 AS d,
    coalesce(TRY_CAST(g.h AS BIGINT), 0) AS h, coalesce(TRY_CAST(g.mi AS BIGINT), 0) AS mi, coalesce(TRY_CAST(g.se AS BIGINT), 0) AS se, g.half AS half, g.z <> '' OR g.sign <> '' AS fixed,
    CASE g.sign WHEN '-' THEN -1 ELSE 1 END * (coalesce(TRY_CAST(g.oh AS BIGINT), 0) * 60 + coalesce(TRY_CAST(g.om AS BIGINT), 0)) AS off, coalesce(TRY_CAST(g.oh AS BIGINT), 0) <= 14 AND coalesce(TRY_CAST(g.om AS BIGINT), 0) <= 59 AS off_ok FROM x
), c AS (
  SELECT *, mi <= 59 AND se <= 59 AND off_ok AND (fixed OR zone IS NOT NULL) AND CASE WHEN half = '' THEN h <= 23 ELSE h BETWEEN 1 AND 12 END AS ok,
    CASE half WHEN '' THEN h WHEN 'A' THEN h % 12 ELSE h % 12 + 12 END * 3600 + mi * 60 + se AS secs,
    TRY_CAST(y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') AS DATE) AS day_first, CASE WHEN slashed THEN TRY_CAST(y || '-' || d || '-' || m AS DATE) END AS month_first FROM f
), v AS (
  SELECT source, count(*) FILTER (day_first IS NOT NULL AND month_first IS NULL) AS dm, count(*) FILTER (day_first IS NULL AND month_first IS NOT NULL) AS md FROM c WHERE ok AND slashed GROUP BY source
), p AS (
  SELECT c.*, ok AND day_first IS NOT NULL AND month_first IS NOT NULL AND day_first <> month_first AS opened, coalesce(dm > 10 * md, false) AS day_wins, coalesce(md > 10 * dm, false) AS month_wins
  FROM c LEFT JOIN v ON v.source IS NOT DISTINCT FROM c.source
), w AS (
  SELECT *, CASE WHEN regexp_full_match(r, '[0-9]{10}|[0-9]{13}') THEN 'epoch' WHEN NOT coalesce(ok, false) OR coalesce(day_first, month_first) IS NULL THEN 'bad' WHEN NOT opened THEN 'plain' WHEN day_wins OR month_wins THEN 'votes' ELSE 'default' END AS rule,
    CAST(CASE WHEN opened AND month_wins THEN month_first ELSE coalesce(day_first, month_first) END AS TIMESTAMP) + to_seconds(secs) AS wall FROM p
), o AS (
  SELECT *, epoch_us(wall) AS us, epoch_us(timezone(zone, timezone('UTC', wall - INTERVAL 1 DAY))) - epoch_us(wall - INTERVAL 1 DAY) AS before,
    epoch_us(timezone(zone, timezone('UTC', wall + INTERVAL 1 DAY))) - epoch_us(wall + INTERVAL 1 DAY) AS after FROM w
), u AS (
  SELECT *, epoch_us(timezone(zone, timezone('UTC', make_timestamp(us - before)))) = us AS early, epoch_us(timezone(zone, timezone('UTC', make_timestamp(us - after)))) = us AS late FROM o
)
SELECT stamp_id, CASE rule WHEN 'bad' THEN NULL WHEN 'epoch' THEN CAST(r AS BIGINT) * CASE length(r) WHEN 10 THEN 1000000 ELSE 1000 END ELSE us - CASE WHEN fixed THEN off * 60000000 WHEN before = after OR (early AND NOT late) THEN before ELSE after END END AS utc_us,
  rule, rule IN ('votes', 'default') OR (rule = 'plain' AND NOT fixed AND before <> after AND early = late) AS ambiguous
FROM u"""


#: Bytes as two hex digits each, windows cut from pieces of 1,000 bytes and the 199 after; runs of covered bytes by places.
SUFFIX_DEDUP = """WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), s AS (
  SELECT k, b, substr(x, 2 * b + 1, 2398) AS piece FROM (SELECT k, x, unnest(range(0, greatest(length(x) // 2 - 199, 0), 1000)) AS b FROM d)
), w AS (
  SELECT k, b + i AS p, md5(substr(piece, 2 * i + 1, 400)) AS win FROM (SELECT k, b, piece, unnest(range(0, least(1000, length(piece) // 2 - 199))) AS i FROM s)
), r AS (
  SELECT k, p FROM (SELECT k, p, count(*) OVER (PARTITION BY win) AS n FROM w) WHERE n > 1
), e AS (
  SELECT k, p, p + 200 AS q, CASE WHEN p <= coalesce(lag(p) OVER (PARTITION BY k ORDER BY p) + 200, -1) THEN 0 ELSE 1 END AS fresh FROM r
), g AS (
  SELECT k, p, q, sum(fresh) OVER (PARTITION BY k ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM e
), u AS (
  SELECT k, run, min(p) AS a, max(q) AS z, lag(max(q), 1, 0) OVER (PARTITION BY k ORDER BY run) AS before FROM g GROUP BY k, run
), v AS (
  SELECT u.k, count(*) AS n_spans, sum(z - a) AS gone, max(z) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY run) AS kept FROM u JOIN d ON d.k = u.k GROUP BY u.k
)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN v ON v.k = d.k"""
