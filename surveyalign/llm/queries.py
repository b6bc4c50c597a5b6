"""Registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from surveyalign.llm.common import documents

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


_RULE_SQL = """
w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 7), ' ')) AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
hot AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM hot) GROUP BY doc_id),
ln AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
dl AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM ln GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
  len(list_filter(words, lambda x: regexp_matches(x, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]'))) AS n_letter_words,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
  len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_stutters
  FROM w LEFT JOIN dl USING (doc_id) LEFT JOIN rep USING (doc_id))"""


@query("op2_quality_rules", f"""
WITH {_RULE_SQL},
b AS (SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN word_chars < 3 * n_words OR word_chars > 10 * n_words THEN 8 ELSE 0 END
  + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 16 ELSE 0 END + CASE WHEN 100 * n_letter_words < 60 * n_words THEN 32 ELSE 0 END
  + CASE WHEN 2 * n_upper > n_letters THEN 64 ELSE 0 END + CASE WHEN 100 * n_stutters > 30 * n_words THEN 128 ELSE 0 END AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept, CAST(bits AS INT) AS fail_bits FROM b""")
def op2_quality_rules(spark, sf_dir):
    """The ledger of all documents under the newest policy."""
    from surveyalign.llm.quality import apply_policy, ledger

    judged = apply_policy(ledger(documents(spark, sf_dir)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


@query("op5_packing")
def op5_packing(spark, sf_dir):
    """All documents packed by concatenation and cutting."""
    import public_tokenizers

    from surveyalign.llm.packing import pack

    pieces = pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("piece_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op10_byte_bpe")
def op10_byte_bpe(spark, sf_dir):
    """All documents encoded and decoded again."""
    import public_tokenizers

    from surveyalign.llm.bpe import decode, encode

    file, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = decode(encode(documents(spark, sf_dir), file, pattern), file)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_substring_dedup", """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 12), ' ')) AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)),
least AS (SELECT g, min(doc_id) AS first_id FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (g) WHERE first_id < doc_id),
pos AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS txt FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)""")
def op9_substring_dedup(spark, sf_dir):
    """Every word of all documents that a window of 13 shares with an earlier document, removed."""
    from surveyalign.llm.passages import remove_repeated_passages

    kept = remove_repeated_passages(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_NEAR_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 2), ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, m = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) ON a = doc_id"""


@query("op1_minhash_near_dedup", _NEAR_SQL)
def op1_minhash_near_dedup(spark, sf_dir):
    """Near-duplicate classes of all documents: 3-word shingles, similarity 0.85."""
    from surveyalign.llm.minhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir), size=3, percent=85)


@query("op7_line_dedup")
def op7_line_dedup(spark, sf_dir):
    """Lines of all documents that equal an earlier line, or if long enough are within two edits of one, removed."""
    from surveyalign.llm.lines import remove_repeated_lines

    kept = remove_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"), exact_chars=1)
    return kept.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2("kept_text", 256).alias("kept_sha256"))


_VECTOR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id
  WHERE list_inner_product(x.e, y.e) / sqrt(list_inner_product(x.e, x.e)) / sqrt(list_inner_product(y.e, y.e)) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT vec_id, coalesce(n, 0) AS n_links, m AS component_id, m = vec_id AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) c ON c.a = vec_id JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) k ON k.a = vec_id"""


@query("op3_embedding_near_dedup", _VECTOR_SQL)
def op3_embedding_near_dedup(spark, sf_dir):
    """Links and classes of all vectors, cosine 0.93 within a label."""
    from surveyalign.llm.embeddings import near_duplicate_vectors

    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.93)


def _licence_sql() -> str:
    """The scan in SQL: the same fixed values, written out as rows."""
    from surveyalign.llm.licence_texts import EQUIVALENT_SPELLINGS, LICENCE_TEXTS

    def quoted(text):
        return "'" + text.replace("'", "''") + "'"

    form = "lower(l)"
    for spelling, common in EQUIVALENT_SPELLINGS.items():
        form = f"replace({form}, {quoted(spelling)}, {quoted(common)})"
    form = f"trim(regexp_replace({form}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    canonical = f"""list_filter(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN regexp_matches(lower(l),
  '^[^\\p{{L}}\\p{{N}}(]*(copyright|\\(c\\)|©|all rights reserved)') THEN '' ELSE {form} END), lambda l: l <> '')"""
    rows = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, texts in LICENCE_TEXTS.items() for text in texts)
    return f"""
WITH known AS (SELECT array_to_string({canonical}, ' ') AS form, min(licence) AS licence FROM (VALUES {rows}) t(licence, text) GROUP BY 1),
d AS (SELECT doc_id, coalesce({canonical}, []) AS lines FROM documents),
n AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT licence)), ',') AS notices, count(*) AS n_notices
  FROM (SELECT doc_id, unnest(lines) AS form FROM d) JOIN known USING (form) GROUP BY doc_id)
SELECT doc_id, licence, coalesce(notices, '') AS notices, coalesce(n_notices, 0) AS n_notices
FROM d LEFT JOIN known ON known.form = array_to_string(lines, ' ') AND len(lines) > 0 LEFT JOIN n USING (doc_id)"""


@query("op6_license_scan", _licence_sql())
def op6_license_scan(spark, sf_dir):
    """Licences of all whole documents and of their lines."""
    from surveyalign.llm.licences import scan_licences

    found = scan_licences(documents(spark, sf_dir))
    return found.withColumn("notices", F.array_join("notices", ","))


@query("op8_html_extraction")
def op8_html_extraction(spark, sf_dir):
    """Main text of all pages."""
    from surveyalign.llm.html_text import extract_main_text, sample_words, train

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = extract_main_text(pages, train(sample_words(pages, "page_id", "html")))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op4_lm_scoring")
def op4_lm_scoring(spark, sf_dir):
    """Scores of all documents under the log-bilinear model and the smoothed unigrams."""
    from surveyalign.llm.language_model import score_documents

    return score_documents(documents(spark, sf_dir))


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark, sf_dir):
    """All vectors whitened on the first 32 components, every row counted in the fit."""
    from surveyalign.llm.whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=32)


@query("op13_nearest_neighbours")
def op13_nearest_neighbours(spark, sf_dir):
    """The 20 largest inner products of every vector whose id is divisible by 20, against all vectors."""
    from surveyalign.llm.nearest import build_index, search

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(build_index(vectors, k=20), vectors.where("vec_id % 20 = 0"))


_SPELLING_SQL = """
WITH RECURSIVE t AS (SELECT list(c ORDER BY k) AS crc FROM (SELECT k, list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
  CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(0, 256)) AS k))),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
  lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [195, CAST(unicode(ch) - 64 AS BIGINT)] END)) AS b FROM r GROUP BY doc_id, run),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(crc[CAST(xor(c, x) & 255 AS INT) + 1], c >> 8))) AS h FROM d, t),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
  ELSE run END AS word FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
s AS (SELECT word, n, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
del AS (SELECT DISTINCT s.word AS x, v.word AS y FROM s JOIN v ON v.word = s.a || s.b),
near AS (SELECT x.word AS x, y.word AS y FROM s x JOIN s y USING (a, b) WHERE x.word <> y.word UNION SELECT x, y FROM del UNION SELECT y, x FROM del),
best AS (SELECT x, count(*) AS n_near, max(n) AS top_n, arg_min(y, (-n, y)) AS top FROM near JOIN v ON v.word = y GROUP BY x),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 2 * n THEN top END AS form, CASE WHEN top_n >= 2 * n THEN top_n END AS form_n FROM v LEFT JOIN best ON x = word),
c AS (SELECT word, word AS last, 0 AS d FROM f UNION ALL SELECT c.word, f.form, d + 1 FROM c JOIN f ON f.word = c.last WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(last, d) AS root FROM c GROUP BY word) USING (word)"""


@query("op11_spelling_variants", _SPELLING_SQL)
def op11_spelling_variants(spark, sf_dir):
    """Near words, forms and roots of all words of all documents, with planted slips."""
    from surveyalign.llm.spelling import spelling_forms, vocabulary, with_slips

    return spelling_forms(vocabulary(with_slips(documents(spark, sf_dir)), 5, 3))
