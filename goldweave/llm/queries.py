"""The thin ``opN_*`` queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from goldweave.llm.sentencepieces import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from goldweave.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from goldweave.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from goldweave.llm.pii import pseudonymize_documents

    key = spark.conf.get("spark.goldweave.pii.key", "a key for test data only")
    return pseudonymize_documents(table(spark, sf_dir, "documents"), key)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from goldweave.llm.media import image_features, store_images

    return image_features(store_images(table(spark, sf_dir, "documents"))).drop("error")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from goldweave.llm.chat import format_branches, read_back, thread

    probe = spark.range(2).selectExpr("-1L conv_id", "id turn", "if(id = 0, 'user', 'assistant') role", "'</s>[INST] ok [/INST]' text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return read_back(format_branches(thread(rows)))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from goldweave.llm.jaccard_join import Rule, join_documents

    return join_documents(table(spark, sf_dir, "documents"), Rule(words=4, num=85, den=100))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from goldweave.llm.exact_dedup import decide_copies

    return decide_copies(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from goldweave.llm.secret_scan import scan_documents

    return scan_documents(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from goldweave.llm.language_id import identify_documents

    return identify_documents(table(spark, sf_dir, "documents"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from goldweave.llm.structure_repair import damage, repair_conversations

    rows = table(spark, sf_dir, "conversations")
    return repair_conversations(damage(rows), rows)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from goldweave.llm.alignment import align_documents

    return align_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from goldweave.llm.byte_pairs import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_sharding": op2_sharding,
    "op3_packing": op3_packing,
    "op4_pii": op4_pii,
    "op5_media": op5_media,
    "op6_chat": op6_chat,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_secrets": op9_secrets,
    "op10_language": op10_language,
    "op11_structure_repair": op11_structure_repair,
    "op12_alignment": op12_alignment,
    "op13_byte_pairs": op13_byte_pairs,
}

#: A-Z alone in lower case.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CONTROL = r"<</SYS>>|<<SYS>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|\[/INST\]|\[INST\]|</s>|<s>"
#: Characters of an escaped text: a backslash is doubled, a control string gets two more.
_ESCAPED = rf"length({{x}}) + length({{x}}) - length(replace({{x}}, '\', '')) + 2 * len(regexp_extract_all({{x}}, '{_CONTROL}'))"


def _spans(kind: str, rank: int, pattern: str, group: int, least: int, extra: str = "true") -> str:
    """Spans of a pattern, placed by the lengths of what lies between matches."""
    return f"""
SELECT doc_id, list_sum(list_transform(gap[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0)::BIGINT AS a, length(hit[i]) AS n, {rank} AS rank, '{kind}' AS kind, hit[i] AS body
FROM (SELECT doc_id, hit, gap, shown, unnest(range(1, len(hit) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS hit, string_split_regex(t, '{pattern}') AS gap, regexp_extract_all(t, '{pattern}', {group}) AS shown FROM d)) WHERE length(shown[i]) >= {least} AND {extra}"""


_ENTROPY = """list_max(list_transform(range(1, length(body) - 18), lambda p: list_sum(list_transform(list_distinct(string_split(substr(body, p, 20), '')),
 lambda c: -((length(substr(body, p, 20)) - length(replace(substr(body, p, 20), c, ''))) / 20.0) * log2((length(substr(body, p, 20)) - length(replace(substr(body, p, 20), c, ''))) / 20.0)))))"""

ORACLE_SQL: dict[str, str] = {
    "op6_chat": rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(24 + {_ESCAPED.format(x='role')} + length(role) - length(replace(role, chr(10), '')) + {_ESCAPED.format(x='text')})::BIGINT AS formatted_chars FROM c GROUP BY 1""",
    "op7_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
f AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s), p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM f a JOIN f b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(node, label) AS (SELECT doc_id, doc_id FROM documents UNION SELECT p.v, r.label FROM r JOIN p ON p.u = r.node WHERE r.label < p.v)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id FROM s JOIN (SELECT node, min(label) AS component_id FROM r GROUP BY 1) c ON c.node = s.doc_id""",
    "op8_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS h, {_LOWER} AS t FROM documents), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (t)""",
    "op9_secrets": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS ({_spans('assign', 0, r"((?i:password|passwd|secret|token|api_?key))[" + '"' + r"'']?\x20*[:=]\x20*[" + '"' + r"'']?([A-Za-z0-9+/_.=-]+)", 2, 12)} UNION ALL {_spans('access', 1, 'AKIA[A-Z0-9]+', 0, 18)} UNION ALL {_spans('hex', 2, '[0-9a-f]{16,}', 0, 16)}),
e AS (SELECT * FROM ({_spans('entropy', 3, '[A-Za-z0-9+/_=-]{20,}', 0, 20)}) x WHERE regexp_matches(body, '[0-9]') AND regexp_matches(body, '[A-Za-z]')
  AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = x.doc_id AND b.a <= x.a AND b.a + b.n >= x.a + x.n)
  AND NOT regexp_matches(body, '^[0-9a-fA-F]{{8}}-([0-9a-fA-F]{{4}}-){{3}}[0-9a-fA-F]{{12}}$') AND NOT regexp_matches(body, '^\d{{4}}-\d{{2}}-\d{{2}}([T_-][0-9-]*)?$') AND NOT regexp_matches(body, '(?i)abcdefghijkl') AND NOT regexp_matches(body, '^([A-Za-z]+[/_-])+[A-Za-z]*\d{{0,4}}$')
  AND {_ENTROPY} >= CASE WHEN regexp_matches(body, '^[0-9a-fA-F]+$') THEN 2.9 WHEN regexp_matches(body, '^[A-Z0-9]+$') THEN 3.4 ELSE 3.6 END),
bs AS (SELECT doc_id, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, rank) AS s, count_if(rank = 0) AS n0, count_if(rank = 1) AS n1, count_if(rank = 2) AS n2 FROM b GROUP BY 1),
al AS (SELECT doc_id, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, rank) AS s FROM (SELECT * FROM b UNION ALL SELECT * FROM e) GROUP BY 1)
SELECT d.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(bs.s, '')) AS base_sha256, coalesce(al.s, '') AS spans FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN al USING (doc_id)""",
    "op11_structure_repair": r"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS d
  FROM conversations, tab),
dam AS (SELECT coalesce(conv_id::VARCHAR, 'null') AS k, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE d WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM src),
num AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY k, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
  NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM dam),
fau AS (SELECT k, turn, role, text, i, left(role, 1) AS r, blank, again AND NOT blank AS dup, cut AND NOT again AND NOT blank AS cut, lag(left(role, 1)) OVER (PARTITION BY k ORDER BY i) AS r0 FROM num),
agg AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(blank)::BIGINT AS blank, count_if(dup)::BIGINT AS duplicate, count_if(cut)::BIGINT AS truncated,
  count_if(i > 1 AND r0 || r NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, max(i) AS n FROM fau GROUP BY k),
go(k, i, v) AS (
  SELECT k, n + 1, [{'c': 0, 'a': '', 't': ''}, {'c': 6, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}, {'c': 3, 'a': 'I', 't': chr(10) || 'assistant:'}, {'c': 0, 'a': '', 't': ''}] FROM agg
  UNION ALL
  SELECT k, i, [list_sort([b[1], {'c': b2.c + 3, 'a': 'I' || b2.a, 't': chr(10) || 'user:' || b2.t}])[1], list_sort([b[2], {'c': b2.c + 3, 'a': 'I' || b2.a, 't': chr(10) || 'user:' || b2.t}])[1], b2, list_sort([b[4], {'c': b[3].c + 3, 'a': 'I' || b[3].a, 't': chr(10) || 'user:' || b[3].t}])[1]]
  FROM (SELECT k, i, b, list_sort([b[3], {'c': b[4].c + 3, 'a': 'I' || b[4].a, 't': chr(10) || 'assistant:' || b[4].t}])[1] AS b2
    FROM (SELECT go.k, f.i, list_transform([1, 2, 3, 4], lambda q: list_sort(list_concat([{'c': v[q].c + 4, 'a': 'D' || v[q].a, 't': v[q].t}],
        CASE WHEN blank OR dup THEN [] ELSE [{'c': 3 + 3 * cut::INT + v[CASE q WHEN 3 THEN 4 ELSE 3 END].c, 'a': 'R' || v[CASE q WHEN 3 THEN 4 ELSE 3 END].a, 't': chr(10) || CASE q WHEN 3 THEN 'assistant:' ELSE 'user:' END || text || v[CASE q WHEN 3 THEN 4 ELSE 3 END].t}] END,
        CASE WHEN blank OR dup OR NOT coalesce((r = 's' AND q = 1) OR (r = 'u' AND q <> 3) OR (r = 'a' AND q = 3), false) THEN [] ELSE [{'c': 3 * cut::INT + v[CASE r WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].c, 'a': 'K' || v[CASE r WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].a,
          't': chr(10) || role || ':' || text || v[CASE r WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].t}] END))[1]) AS b
      FROM go JOIN fau f ON f.k = go.k AND f.i = go.i - 1)))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v[1].c, 0)::BIGINT AS cost, coalesce(v[1].a, '') AS audit, sha256(coalesce(substr(v[1].t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, 'null') AS k FROM conversations) o LEFT JOIN agg USING (k) LEFT JOIN go ON go.k = o.k AND go.i = 1""",
}
