"""The operators as registered queries, with the production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowcheck.llm.common import read


def op1_decontaminate(spark, sf_dir):
    from rowcheck.llm.decontaminate import leaks

    found = leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("n_places"), F.min("edits").alias("edits"), F.min("begin").alias("first_begin")
    )


def op2_substring_dedup(spark, sf_dir):
    from rowcheck.llm.substring import dedup_substrings

    return dedup_substrings(read(spark, sf_dir, "documents"), 13)


def op3_bpe(spark, sf_dir):
    import public_tokenizers

    from rowcheck.llm.bpe import encode_and_decode

    return encode_and_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_pii(spark, sf_dir):
    from rowcheck.llm.pii import find

    return find(read(spark, sf_dir, "documents"))


def op5_hmm_scores(spark, sf_dir):
    from rowcheck.llm.hmm import score_texts

    return score_texts(read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark, sf_dir):
    from rowcheck.llm.exact import exact_groups

    return exact_groups(read(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    from rowcheck.llm.quality import classify

    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_urls(spark, sf_dir):
    from rowcheck.llm.urls import judge, listed_in

    pages = read(spark, sf_dir, "pages")
    return judge(pages, listed_in(pages))


def op9_token_counts(spark, sf_dir):
    import public_tokenizers

    from rowcheck.llm.tokens import count_tokens

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_simhash(spark, sf_dir):
    from rowcheck.llm.simhash import near_groups

    return near_groups(read(spark, sf_dir, "documents"))


def op11_token_files(spark, sf_dir):
    import public_tokenizers

    from rowcheck.llm.packing import round_trip

    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_hard_negatives(spark, sf_dir):
    from rowcheck.llm.negatives import hard_negatives

    moved = lambda vec_id, label: F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(read(spark, sf_dir, "embeddings"), 50, moved)


def op13_lexical_search(spark, sf_dir):
    from rowcheck.llm.search import search

    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f for f in (
        op1_decontaminate,
        op2_substring_dedup,
        op3_bpe,
        op4_pii,
        op5_hmm_scores,
        op6_exact_dedup,
        op7_quality,
        op8_urls,
        op9_token_counts,
        op10_simhash,
        op11_token_files,
        op12_hard_negatives,
        op13_lexical_search,
    )
}

_EXACT = r"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)
"""

_SUBSTRING = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t WHERE len(w) >= 13)),
low AS (SELECT k, min(doc_id) AS low FROM p GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM p JOIN low USING (k) WHERE low < doc_id),
kept AS (SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.i) AS x, count(*) AS n
         FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t) a ANTI JOIN gone g ON a.doc_id = g.doc_id AND a.i = g.i GROUP BY a.doc_id)
SELECT t.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(x, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""

_URLS = r"""
WITH u AS (SELECT page_id, html, url LIKE '%://%' AS whole, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
s AS (SELECT *, array_to_string(list_transform(str_split(path, '%'), lambda x, i: CASE WHEN i = 1 THEN x
        WHEN regexp_full_match(x[1:2], '[2-7][0-9A-Fa-f]') AND regexp_full_match(chr(TRY_CAST('0x' || x[1:2] AS INTEGER)), '[A-Za-z0-9._~-]') THEN chr(TRY_CAST('0x' || x[1:2] AS INTEGER)) || x[3:]
        WHEN regexp_full_match(x[1:2], '[0-9A-Fa-f]{2}') THEN '%' || upper(x[1:2]) || x[3:] ELSE '%' || x END), '') AS spelled FROM u),
d AS (SELECT *, CASE WHEN contains(spelled, '/.') THEN list_reduce(str_split(spelled[2:], '/'), lambda a, x: CASE x WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN '.' THEN a ELSE a || '/' || x END, '') ELSE spelled END AS plain FROM s),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:(80|443)?)?$', ''), '^www\.', '') || regexp_replace(plain, '(/|\.html?)$', '') AS url,
      CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
           WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
           WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
           WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
           WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM d),
h AS (SELECT url, nullif(regexp_extract(coalesce(html, ''), '<h1>([^<]*)</h1>', 1), '') AS title,
      regexp_matches(html, '(%%%|\*\*\*|\$\$\$|&amp;&amp;&amp;|###|@@@|~~~|\^\^\^)') AS shows FROM c WHERE whole),
listed AS (SELECT DISTINCT url FROM h WHERE title IN (SELECT title FROM h WHERE shows AND title IS NOT NULL) OR (title IS NULL AND shows))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN url IN (SELECT url FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""

_NEGATIVES = r"""
WITH whole AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM whole a JOIN whole b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
neg AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
        FROM pos p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
"""

_SEARCH = r"""
WITH word AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM word GROUP BY ALL),
doc AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
al AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM doc),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, al GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // l))))::BIGINT AS score
           FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN doc USING (doc_id), al GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= 10
"""

ORACLES = {"op2_substring_dedup": _SUBSTRING, "op6_exact_dedup": _EXACT, "op8_urls": _URLS, "op12_hard_negatives": _NEGATIVES, "op13_lexical_search": _SEARCH}
