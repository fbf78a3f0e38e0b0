"""DuckDB fragments that the oracles share, written apart from the Spark plans."""

from __future__ import annotations

TOKENS = """d AS (
  SELECT doc_id, lang, source, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x <> '') AS toks FROM documents
), tokens AS (
  SELECT doc_id, lang, source, unnest(toks) AS tok, CAST(unnest(range(len(toks))) AS BIGINT) AS pos FROM d
)"""

DICT = """b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x <> '') AS toks FROM benchmark
), btok AS (
  SELECT item_id, unnest(toks) AS tok, CAST(unnest(range(len(toks))) AS BIGINT) AS pos FROM b
), dict AS (SELECT tok AS word, count(*) AS freq FROM btok GROUP BY 1
), bpair AS (
  SELECT tok AS w1, lead(tok) OVER (PARTITION BY item_id ORDER BY pos) AS w2 FROM btok
), bigram AS (
  SELECT w1, w2, count(*) AS c, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY w1) AS p FROM bpair WHERE w2 IS NOT NULL GROUP BY w1, w2
)"""

CHARS = """chars AS (
  SELECT doc_id, lang, unnest(string_split(array_to_string(toks, ''), '')) AS ch,
         unnest(range(length(array_to_string(toks, '')))) AS i FROM d WHERE len(toks) > 0
), nexts AS (
  SELECT doc_id, lang, ch AS c1, lead(ch) OVER w AS c2, lead(ch, 2) OVER w AS c3 FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY i)
)"""

PAIRS = """pairs AS (
  SELECT doc_id, lang, source, tok AS w1, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS w2, pos FROM tokens
)"""


def skeleton(expr: str) -> str:
    s = f"regexp_replace(translate(lower({expr}), 'ckqgtdpbvfszxlrmn', 'KKKKTTPPPPSSSLRMN'), '[^A-Z]', '', 'g')"
    for c in "KTPSLRMN":
        s = f"regexp_replace({s}, '{c}+', '{c}', 'g')"
    return f"rtrim(regexp_replace({s}, '(.)', '\\1-', 'g'), '-')"


def pos_tag(w: str) -> str:
    from stratalex.functions import text as t

    def any_of(xs):
        return ", ".join(f"'{x}'" for x in xs)

    return (
        f"CASE WHEN {w} = '' THEN 'OTHER' WHEN {w} IN ({any_of(t.PREPOSITIONS)}) THEN 'PREP' WHEN {w} IN ({any_of(t.CONJUNCTIONS)}) THEN 'CONJ' "
        f"WHEN {w} IN ({any_of(t.ADVERBS)}) THEN 'ADV' WHEN {w} IN ({any_of(t.DETERMINERS)}) THEN 'DET' "
        f"WHEN length({w}) > 3 AND regexp_matches({w}, '({'|'.join(t.VERB_ENDINGS)})$') THEN 'VERB' "
        f"WHEN length({w}) > 3 AND regexp_matches({w}, '({'|'.join(t.ADJECTIVE_ENDINGS)})$') THEN 'ADJ' ELSE 'NOUN' END"
    )


def entropy(c: str, key: str = "") -> str:
    """Entropy in bits of counts ``c`` within groups: p = c / sum(c)."""
    return f"-sum(({c}) * 1.0 / t * log2(({c}) * 1.0 / t))"
