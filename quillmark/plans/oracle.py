"""SQL twins of the catalogue's queries for DuckDB."""

from __future__ import annotations

from quillmark.functions import names
from quillmark.operators import moves
from quillmark.operators import sections as se
from quillmark.operators.citations import NON_AUTHORS, PATTERNS, SUBSETS
from quillmark.operators.words import STOPWORDS
from quillmark.plans.inputs import BOXES, GROUPED, HEADED, PAPERS, PARTS, SECTIONS, TERMS

SQL: dict[str, str] = {}
_W = r"[\p{L}\p{M}\p{N}_]+"
_STOP = "('" + "', '".join(STOPWORDS) + "')"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _syl(w: str) -> str:
    n = f"len(regexp_extract_all({w}, '[aeiouy]+'))"
    silent = f"(({w} LIKE '%e' AND NOT regexp_matches({w}, '[^aeiouy]le$')) OR ({w} LIKE '%ed' AND NOT regexp_matches({w}, '[td]ed$|ied$')) OR ({w} LIKE '%es' AND NOT regexp_matches({w}, '[aeiou]les$|ies$|ues$')))"
    hiatus = f"(regexp_matches({w}, 'i[aou][ns]$') AND NOT regexp_matches({w}, '[aeiou]i[aou][ns]$'))"
    return f"greatest(1, {n} + CASE WHEN {silent} AND {n} > 1 THEN -1 WHEN {hiatus} THEN 1 ELSE 0 END)"


SQL["readability_indices"] = f"""
WITH a AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{_W}'), lambda w: regexp_matches(w, '^[a-z]+$')) AS ws,
  len(list_filter(regexp_split_to_array(trim(text), '[.!?]+\\s+|[.!?]+$'), lambda s: length(trim(s)) > 0)) AS s FROM documents),
b AS (SELECT doc_id, s, len(ws) AS w, list_sum(list_transform(ws, lambda x: length(x))) AS c, list_transform(ws, lambda x: {_syl('x')}) AS sy FROM a),
c AS (SELECT doc_id, s, w, c, list_sum(sy) AS y, len(list_filter(sy, lambda n: n >= 3)) AS x, s > 0 AND w > 0 AS good FROM b)
SELECT doc_id, CASE WHEN good THEN round(0.39 * (w / s) + 11.8 * (y / w) - 15.59 + 1e-9, 2) + 0.0 END AS flesch_kincaid_grade, CASE WHEN good THEN round(206.835 - 1.015 * (w / s) - 84.6 * (y / w) + 1e-9, 2) + 0.0 END AS flesch_reading_ease,
 CASE WHEN good THEN round(4.71 * (c / w) + 0.5 * (w / s) - 21.43 + 1e-9, 2) + 0.0 END AS automated_readability_index, CASE WHEN good THEN round(0.4 * (w / s + x / w * 100) + 1e-9, 2) + 0.0 END AS gunning_fog_index,
 CASE WHEN good THEN s END AS n_sentences, CASE WHEN good THEN w END AS n_words, CASE WHEN good THEN y END AS n_syllables, CASE WHEN good THEN c END AS n_characters, CASE WHEN good THEN x END AS n_complex_words,
 CASE WHEN good THEN round(w / s + 1e-9, 2) + 0.0 END AS avg_sentence_length, CASE WHEN good THEN round(y / w + 1e-9, 2) + 0.0 END AS avg_syllables_per_word, CASE WHEN good THEN round(x / w * 100 + 1e-9, 2) + 0.0 END AS pct_complex_words FROM c"""
SQL["syllable_counts"] = f"""
SELECT word, {_syl('word')} AS n_syllables FROM (SELECT DISTINCT unnest(list_filter(regexp_extract_all(lower(text), '{_W}'), lambda w: regexp_matches(w, '^[a-z]+$'))) AS word FROM documents)"""
_SQ = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
SQL["text_stats"] = f"""
SELECT doc_id, length(t) AS n_chars, len(regexp_split_to_array(t, '\\s+')) AS n_words, len(regexp_split_to_array(t, '[.!?]+')) AS n_sentences,
 round(len(regexp_split_to_array(t, '\\s+')) / len(regexp_split_to_array(t, '[.!?]+')), 2) AS avg_words_per_sentence FROM (SELECT doc_id, {_SQ} AS t FROM documents WHERE text IS NOT NULL)"""


def _words(keys: str, source: str, least: int = 1, stop: bool = False, numbers: bool = False) -> str:
    """CTE ``w``: keys, pos, word."""
    return f"""w AS (SELECT * FROM (SELECT {keys}, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (SELECT {keys}, regexp_extract_all(lower(text), '{_W}') AS ws FROM {source}))
  WHERE length(word) >= {least}{"" if numbers else " AND NOT regexp_matches(word, '^[0-9]+$')"}{f" AND word NOT IN {_STOP}" if stop else ""})"""


_S = "(SELECT DISTINCT paper_id, sentence_id, text FROM sentences WHERE text IS NOT NULL)"
SQL["word_frequencies"] = f"""
WITH {_words('paper_id, sentence_id', _S, 3)}, n AS (SELECT paper_id, word, count(*) AS n FROM w GROUP BY 1, 2)
SELECT paper_id, word, n, round(n / sum(n) OVER (PARTITION BY paper_id), 6) AS frequency, row_number() OVER (PARTITION BY paper_id ORDER BY n DESC, word) AS rank FROM n"""
SQL["stopword_antijoin"] = f"""WITH {_words('paper_id, sentence_id', _S, stop=True)} SELECT paper_id, count(*) AS n_words, count(DISTINCT word) AS n_unique FROM w GROUP BY 1"""
SQL["lexical_diversity"] = f"""
WITH {_words('paper_id, sentence_id', _S)} SELECT paper_id, count(*) AS n_words, count(DISTINCT word) AS n_unique, round(count(DISTINCT word) / count(*), 6) AS lexical_diversity FROM w GROUP BY 1"""


def _grams(keys: str, sizes=(1, 2, 3)) -> str:
    """CTE ``g``: keys, n, ngram from arrays ``a`` (keys, ws)."""
    return "g AS (" + " UNION ALL ".join(f"SELECT {keys}, {n} AS n, unnest(list_transform(range(1, len(ws) - {n} + 2), lambda i: array_to_string(ws[i : i + {n} - 1], ' '))) AS ngram FROM a WHERE len(ws) >= {n}" for n in sizes) + ")"


SQL["ngram_top15"] = f"""
WITH {_words('paper_id, sentence_id', _S, stop=True)}, a AS (SELECT paper_id, sentence_id, list(word ORDER BY pos) AS ws FROM w GROUP BY 1, 2), {_grams('paper_id')},
c AS (SELECT paper_id, n, ngram, count(*) AS cnt FROM g GROUP BY 1, 2, 3), r AS (SELECT *, sum(cnt) OVER (PARTITION BY paper_id, n) AS total, row_number() OVER (PARTITION BY paper_id, n ORDER BY cnt DESC, ngram) AS rank FROM c)
SELECT paper_id, n, ngram, cnt, rank, round(cnt / CASE WHEN n = 1 THEN total ELSE sum(cnt) OVER (PARTITION BY paper_id, n) END, 6) AS frequency FROM r WHERE rank <= 15"""
_SEL = "('museum', 'valley', 'market', 'central valley', 'second flood', 'old bridge')"


def _distribution(keys: str, source: str) -> str:
    on = " AND ".join(f"a.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    return f"""{_words(keys, source, stop=True, numbers=True)}, a AS (SELECT {keys}, list(word ORDER BY pos) AS ws FROM w GROUP BY ALL), {_grams(keys)},
  c AS (SELECT {keys}, ngram AS word, count(*) AS count FROM g WHERE ngram IN {_SEL} GROUP BY ALL),
  dist AS (SELECT c.*, len(ws) AS total_words, round(count / len(ws), 6) AS relative_frequency FROM c JOIN a ON {on})"""


_SEG = f"""seg AS (SELECT doc_id, s AS segment, substring(t, (s - 1) * k + 1, k) AS text FROM (SELECT doc_id, t, CAST(ceil(length(t) / 10) AS INT) AS k, unnest(range(1, 11)) AS s FROM (SELECT doc_id, {_SQ} AS t FROM documents WHERE length(trim(text)) > 0)))"""
SQL["word_distribution_segments"] = f"WITH {_SEG}, {_distribution('doc_id, segment', 'seg')} SELECT * FROM dist"
SQL["word_distribution_sections"] = f"WITH {SECTIONS}, {_distribution('doc_id, section', 'sections')} SELECT * FROM dist"
SQL["word_distribution_dense"] = f"""WITH {SECTIONS}, {_distribution('doc_id, section', 'sections')}
SELECT s.doc_id, s.section, t.word, coalesce(d.count, 0) AS count, coalesce(d.relative_frequency, 0.0) AS relative_frequency FROM (SELECT DISTINCT doc_id, section FROM sections) s, (SELECT unnest(['museum', 'valley', 'market', 'central valley', 'second flood', 'old bridge']) AS word) t
LEFT JOIN dist d ON s.doc_id = d.doc_id AND s.section = d.section AND t.word = d.word"""

_TFIDF = f"""{TERMS}, tot AS (SELECT paper_id, section, sum(n) AS total, count(*) OVER (PARTITION BY paper_id) AS ns FROM terms GROUP BY 1, 2),
 dfs AS (SELECT *, count(*) OVER (PARTITION BY paper_id, ngram) AS df FROM terms),
 tfidf AS (SELECT d.paper_id, d.section, d.ngram, d.n, round(d.n / total, 6) AS tf, round(ln(ns / df), 6) AS idf, round(d.n / total * ln(ns / df), 6) AS tf_idf FROM dfs d JOIN tot t ON d.paper_id = t.paper_id AND d.section = t.section)"""
SQL["tfidf_by_section"] = f"WITH {_TFIDF} SELECT * FROM tfidf"
_TOP = lambda k: f"top AS (SELECT * FROM (SELECT paper_id, section, ngram, n, tf_idf, row_number() OVER (PARTITION BY paper_id, section ORDER BY tf_idf DESC, ngram) AS rank FROM tfidf) WHERE rank <= {k})"
SQL["tfidf_top_n"] = f"WITH {_TFIDF}, {_TOP(10)} SELECT * FROM top"
SQL["cluster_summary"] = f"WITH {_TFIDF}, {_TOP(5)} SELECT paper_id, section, string_agg(ngram, ', ' ORDER BY rank) AS top_terms, count(*) AS n_terms FROM top GROUP BY 1, 2"
SQL["tfidf_heatmap"] = f"""WITH {_TFIDF}, {_TOP(10)}, k AS (SELECT paper_id, count(DISTINCT section) AS k FROM top GROUP BY 1),
t AS (SELECT top.paper_id, ngram, max(CASE WHEN rank <= greatest(1, floor(20 / k)) THEN 1 ELSE 0 END) AS first, max(tf_idf) AS score FROM top JOIN k ON top.paper_id = k.paper_id GROUP BY 1, 2)
SELECT paper_id, ngram, score, term_rank FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY first DESC, score DESC, ngram) AS term_rank FROM t) WHERE term_rank <= 20"""

# Citations ------------------------------------------------------------------------
_non = "(" + ", ".join(map(_q, NON_AUTHORS)) + ")"


def _hits() -> str:
    parts = []
    for order, (name, pattern) in enumerate(PATTERNS.items()):
        keep = f" WHERE regexp_extract(hit, '\\(?([A-Z][A-Za-z''-]+)', 1) NOT IN {_non}" if "narrative" in name or "author_year" in name else ""
        parts.append(f"""SELECT doc_id, {order} AS ord, {_q(name)} AS citation_type, {_q(name + '_')} || k AS citation_id, hit AS citation_text, start_pos, start_pos + length(hit) - 1 AS end_pos FROM (
   SELECT doc_id, k, hs[k] AS hit, 1 + coalesce(list_sum(list_transform(gs[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hs[1:k - 1], lambda x: length(x))), 0) AS start_pos FROM (
    SELECT doc_id, hs, gs, unnest(range(1, len(hs) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(t, {_q(pattern)}) AS hs, regexp_split_to_array(t, {_q(pattern)}) AS gs FROM sq))){keep}""")
    return f"{PAPERS}, sq AS (SELECT doc_id, {_SQ} AS t FROM papers), hits AS (" + " UNION ALL ".join(parts) + ")"


_HITS = _hits()
SQL["citation_scan"] = f"WITH {_HITS} SELECT doc_id, citation_type, citation_id, citation_text, CAST(start_pos AS INT) AS start_pos, CAST(end_pos AS INT) AS end_pos FROM hits"
_SWEEP = f"""{_HITS}, ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_pos, start_pos - end_pos, ord) AS rn FROM hits),
 nxt AS MATERIALIZED (SELECT a.doc_id, a.rn, min(b.rn) AS nx FROM ranked a LEFT JOIN ranked b ON a.doc_id = b.doc_id AND b.start_pos >= a.end_pos AND b.rn > a.rn GROUP BY 1, 2),
 walk AS (SELECT doc_id, CAST(1 AS BIGINT) AS rn FROM ranked WHERE rn = 1 UNION ALL SELECT w.doc_id, n.nx FROM walk w JOIN nxt n ON w.doc_id = n.doc_id AND w.rn = n.rn WHERE n.nx IS NOT NULL),
 swept AS (SELECT r.doc_id, row_number() OVER (PARTITION BY r.doc_id ORDER BY r.rn) AS citation_ord, citation_type, citation_id, citation_text, CAST(start_pos AS INT) AS start_pos, CAST(end_pos AS INT) AS end_pos FROM ranked r JOIN walk w ON r.doc_id = w.doc_id AND r.rn = w.rn)"""
_WITH = f"WITH RECURSIVE {_SWEEP}"
SQL["citation_sweep"] = f"{_WITH} SELECT * FROM swept"
_EXP = r""", expanded AS (SELECT doc_id, citation_ord, citation_type, citation_id, citation_text, start_pos, end_pos, CAST(NULL AS VARCHAR) AS original_complex_citation FROM swept WHERE citation_type NOT IN ('complex_multiple_citations', 'multiple_citations_semicolon')
 UNION ALL SELECT doc_id, citation_ord, 'parsed_from_multiple', 'parsed_multiple_' || citation_ord || '_' || j, '(' || trim(p[j]) || ')', start_pos, end_pos, citation_text FROM (SELECT *, unnest(range(1, len(p) + 1)) AS j FROM (
   SELECT *, regexp_split_to_array(regexp_replace(regexp_replace(citation_text, '^\((?:see\s+)?(?:e\.g\.\s+)?(?:cf\.\s+)?(?:compare\s+)?', ''), '\)$', ''), '\s*;\s*') AS p FROM swept WHERE citation_type IN ('complex_multiple_citations', 'multiple_citations_semicolon')))
 WHERE regexp_matches(p[j], '\d{4}'))"""
SQL["citation_expand"] = f"{_WITH}{_EXP} SELECT * FROM expanded"
_STD = r""", std AS (SELECT *, CASE WHEN citation_type LIKE '%narrative%' THEN regexp_extract(citation_text, '^([^(]+)', 1) END AS author_part, CASE WHEN citation_type LIKE '%narrative%' THEN nullif(regexp_extract(citation_text, '(\(\d{4}[a-z]?\))', 1), '') END AS year_part FROM expanded)"""
SQL["citation_standardize"] = f"{_WITH}{_EXP}{_STD} SELECT doc_id, citation_id, author_part, year_part, coalesce('(' || trim(author_part) || ', ' || translate(year_part, '()', '') || ')', citation_text) AS citation_text_clean FROM std"
SQL["citation_types"] = f"{_WITH} SELECT doc_id, citation_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY doc_id) * 100, 2) AS percentage FROM swept GROUP BY 1, 2"
SQL["narrative_ratio"] = f"""{_WITH} SELECT doc_id, count(*) AS total_citations, sum(CASE WHEN citation_type LIKE '%narrative%' THEN 1 ELSE 0 END) AS narrative_citations, sum(CASE WHEN citation_type LIKE '%narrative%' THEN 0 ELSE 1 END) AS parenthetical_citations,
 round(sum(CASE WHEN citation_type LIKE '%narrative%' THEN 1 ELSE 0 END) / count(*) * 100, 2) AS narrative_percentage FROM swept GROUP BY 1"""
SQL["citation_density"] = f"""{_WITH} SELECT s.doc_id, w AS total_words, coalesce(n, 0) AS n_citations, round(coalesce(n, 0) / w * 1000, 2) AS citations_per_1000_words, CASE WHEN n > 0 THEN round(w / n, 2) END AS avg_words_between_citations
 FROM (SELECT doc_id, len(regexp_split_to_array(t, '\\s+')) AS w FROM sq) s LEFT JOIN (SELECT doc_id, count(*) AS n FROM swept GROUP BY 1) c ON s.doc_id = c.doc_id"""
SQL["citation_segments"] = f"""{_WITH}, b AS (SELECT *, min(start_pos) OVER (PARTITION BY doc_id) AS lo, max(start_pos) OVER (PARTITION BY doc_id) AS hi FROM swept)
SELECT doc_id, citation_id, start_pos, 'Segment ' || CASE WHEN start_pos = lo THEN 1 ELSE CAST(least(10, ceil((start_pos - lo) / ((hi - lo) / 10))) AS INT) END AS segment FROM b"""
_PARTS = f""", fivep AS (SELECT doc_id, t, CAST(ceil(length(t) / {len(PARTS)}) AS INT) AS k, unnest(range({len(PARTS)})) AS i FROM sq),
 five AS (SELECT doc_id, i + 1 AS section_ord, [{', '.join(map(_q, PARTS))}][i + 1] AS section, length(trim(substring(t, i * k + 1, k))) + 1 AS size FROM fivep),
 spans AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY section_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM five),
 placed AS (SELECT c.*, coalesce(s.section, 'Unknown') AS section FROM swept c LEFT JOIN spans s ON c.doc_id = s.doc_id AND c.start_pos BETWEEN s.before + 1 AND s.before + s.size)"""
SQL["citation_sections"] = f"{_WITH}{_PARTS} SELECT doc_id, citation_id, section FROM placed"
SQL["section_distribution"] = f"""{_WITH}{_PARTS}, n AS (SELECT doc_id, section, count(*) AS n FROM placed GROUP BY 1, 2), e AS (SELECT coalesce(f.doc_id, n.doc_id) AS doc_id, coalesce(f.section, n.section) AS section, coalesce(n, 0) AS n FROM five f FULL JOIN n ON f.doc_id = n.doc_id AND f.section = n.section)
SELECT doc_id, section, n, CASE WHEN sum(n) OVER (PARTITION BY doc_id) > 0 THEN round(n / sum(n) OVER (PARTITION BY doc_id) * 100, 2) ELSE 0.0 END AS percentage FROM e"""
SQL["citation_contexts"] = f"""{_WITH}, nx AS (SELECT a.doc_id, a.citation_id, min(b.start_pos) AS following FROM swept a LEFT JOIN swept b ON a.doc_id = b.doc_id AND b.start_pos > a.end_pos GROUP BY 1, 2),
x AS (SELECT s.*, regexp_extract_all(substring(t, 1, s.start_pos - 1), '{_W}') AS b, regexp_extract_all(substring(t, s.end_pos + 1, coalesce(following - s.end_pos - 1, length(t))), '{_W}') AS a FROM swept s JOIN sq ON s.doc_id = sq.doc_id JOIN nx ON s.doc_id = nx.doc_id AND s.citation_id = nx.citation_id),
y AS (SELECT *, array_to_string(b[greatest(len(b) - 9, 1):len(b)], ' ') AS words_before, array_to_string(a[1:10], ' ') AS words_after FROM x)
SELECT doc_id, citation_id, citation_type, citation_text, start_pos, end_pos, words_before, words_after, trim(words_before || ' ' || citation_text || ' ' || words_after) AS full_context, len(b) + len(a) AS context_word_count, least(len(b), 10) + least(len(a), 10) AS window_word_count,
 citation_type LIKE '%narrative%' AS is_narrative, citation_type = 'parsed_from_multiple' AS is_parsed_multiple FROM y"""
_PAIRS = """, pairs AS (SELECT a.doc_id, a.citation_ord AS ord1, b.citation_ord AS ord2, a.citation_text AS citation1, b.citation_text AS citation2, b.start_pos - a.end_pos AS distance, a.citation_type AS type1, b.citation_type AS type2
 FROM swept a JOIN swept b ON a.doc_id = b.doc_id AND a.citation_ord < b.citation_ord AND b.start_pos - a.end_pos <= 1000)"""
SQL["citation_cooccurrence"] = f"{_WITH}{_PAIRS} SELECT * FROM pairs"
_EDGES = ", edges AS (SELECT doc_id, ord1, ord2, citation1, citation2, distance, round(greatest(0.5, 3 - abs(distance) / 200), 3) AS width, CASE WHEN abs(distance) <= 300 THEN 'near' WHEN abs(distance) <= 600 THEN 'medium' ELSE 'far' END AS distance_class FROM pairs WHERE abs(distance) <= 600)"
SQL["network_edges"] = f"{_WITH}{_PAIRS}{_EDGES} SELECT * FROM edges"
_NODES = """, deg AS (SELECT doc_id, citation, count(*) AS connections FROM (SELECT doc_id, citation1 AS citation FROM edges UNION ALL SELECT doc_id, citation2 FROM edges) GROUP BY 1, 2 HAVING count(*) >= 2),
 fs AS (SELECT doc_id, citation_text AS citation, section, min(citation_ord) AS o FROM placed GROUP BY 1, 2, 3), sn AS (SELECT doc_id, citation, string_agg(section, ', ' ORDER BY o, section) AS sections, count(*) AS n_sections, first(section ORDER BY o, section) AS primary_section FROM fs GROUP BY 1, 2),
 nodes AS (SELECT d.doc_id, d.citation, connections, sections, n_sections, primary_section, round(least(greatest(15 + connections * 3, 15), 40) / 2, 3) AS size, CASE WHEN n_sections > 1 THEN 3 ELSE 1 END AS border,
  CASE WHEN length(d.citation) > 25 THEN substring(d.citation, 1, 22) || '...' ELSE d.citation END AS label FROM deg d LEFT JOIN sn ON d.doc_id = sn.doc_id AND d.citation = sn.citation)"""
SQL["network_nodes"] = f"{_WITH}{_PAIRS}{_EDGES}{_PARTS}{_NODES} SELECT * FROM nodes"
SQL["network_stats"] = f"""{_WITH}{_PAIRS}{_EDGES}{_PARTS}{_NODES}, kept AS (SELECT * FROM edges e WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.doc_id = e.doc_id AND n.citation = e.citation1) AND EXISTS (SELECT 1 FROM nodes n WHERE n.doc_id = e.doc_id AND n.citation = e.citation2))
SELECT a.doc_id, n_nodes, multi_section_nodes, coalesce(n_edges, 0) AS n_edges, avg_distance FROM (SELECT doc_id, count(*) AS n_nodes, sum(CASE WHEN n_sections > 1 THEN 1 ELSE 0 END) AS multi_section_nodes FROM nodes GROUP BY 1) a
LEFT JOIN (SELECT doc_id, count(*) AS n_edges, round(avg(abs(distance)), 1) AS avg_distance FROM kept GROUP BY 1) b ON a.doc_id = b.doc_id"""

# References -----------------------------------------------------------------------
_REFS = r"""prefs AS (SELECT doc_id, t AS ref_full_text, row_number() OVER (PARTITION BY doc_id ORDER BY t) AS ref_ord FROM (SELECT DISTINCT paper_id AS doc_id, trim(regexp_replace(ref_full_text, '\s+', ' ', 'g')) AS t FROM matched_citations WHERE length(ref_full_text) >= 15)),
 fcount AS (SELECT doc_id, sum(CASE WHEN regexp_matches(ref_full_text, '\(\d{4}[a-z]?\)') THEN 1 ELSE 0 END) AS p, sum(CASE WHEN regexp_matches(ref_full_text, ',\s*\d{4}[a-z]?\.') THEN 1 ELSE 0 END) AS b, sum(CASE WHEN regexp_matches(ref_full_text, '^\[?\d+\]?\.?\s') THEN 1 ELSE 0 END) AS m FROM prefs WHERE ref_ord <= 10 GROUP BY 1),
 fmt AS (SELECT doc_id, CASE WHEN m >= p AND m >= b AND m >= 2 THEN 'numbered' WHEN b > p THEN 'author_year_bare' ELSE 'author_year_paren' END AS ref_format FROM fcount)"""
SQL["reference_format"] = f"WITH {_REFS} SELECT * FROM fmt"
SQL["reference_years"] = rf"""WITH {_REFS}, y AS (SELECT r.*, ref_format, nullif(regexp_extract(ref_full_text, '\((\d{{4}}[a-z]?)\)', 1), '') AS a, nullif(regexp_extract(ref_full_text, ',\s(\d{{4}}[a-z]?)\.', 1), '') AS b, nullif(regexp_extract(ref_full_text, '(?:^|[^\p{{L}}\p{{N}}_])((?:1[89]\d{{2}}|20[0-2]\d)[a-z]?)[.,;)\s]', 1), '') AS c FROM prefs r JOIN fmt ON r.doc_id = fmt.doc_id),
z AS (SELECT *, CASE WHEN ref_format = 'author_year_bare' THEN coalesce(b, a, c) ELSE coalesce(a, b, c) END AS yr FROM y)
SELECT doc_id, ref_ord, ref_format, CASE WHEN CAST(yr[1:4] AS INT) BETWEEN 1800 AND 2027 THEN yr END AS ref_year FROM z"""


def _plain(x: str) -> str:
    return f"replace(replace(replace(translate({x}, '{names.ACCENTED}', '{names.FOLDED}'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')"


def _normal(x: str) -> str:
    s = f"regexp_replace({_plain(f'lower(trim({x}))')}, '{names.PARTICLE}', '')"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({s}, '-', ' ', 'g'), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g'), '\\s+', ' ', 'g'))"


SQL["author_normalize"] = f"SELECT DISTINCT family_name, {_normal('family_name')} AS normal_name FROM authors WHERE family_name IS NOT NULL"
SQL["author_match"] = rf"""
WITH c AS (SELECT DISTINCT cite_author, regexp_extract(ref_authors, '(\p{{Lu}}[\p{{L}}''-]{{2,}})', 1) AS ref_name FROM matched_citations WHERE ref_authors IS NOT NULL), n AS (SELECT *, {_normal('cite_author')} AS x, {_normal('ref_name')} AS y FROM c),
m AS (SELECT *, CASE WHEN length(x) = length(y) THEN len(list_filter(range(1, length(x) + 1), lambda i: x[i] <> y[i])) END AS ex FROM n)
SELECT cite_author, ref_name, coalesce(length(x) > 0 AND length(y) > 0 AND (x = y OR contains(x, y) OR contains(y, x) OR (length(x) = length(y) AND ex <= CASE WHEN length(x) > 5 THEN 2 ELSE 1 END)
 OR (least(length(x), length(y)) / greatest(length(x), length(y)) >= 0.7 AND 1 - levenshtein(x, y) / greatest(length(x), length(y)) >= 0.8)), false) AS same FROM m"""

# Moves ----------------------------------------------------------------------------
_STORED = "st AS (SELECT DISTINCT paper_id, coalesce(trim(section), 'Unnamed') AS section, sentence_id, move, step, confidence, method FROM sentences)"
SQL["move_distribution"] = f"WITH {_STORED} SELECT paper_id, section, move, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY paper_id, section) * 100, 1) AS pct FROM st GROUP BY 1, 2, 3"
SQL["step_distribution"] = f"WITH {_STORED} SELECT paper_id, section, move, step, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY paper_id, section) * 100, 1) AS pct FROM st GROUP BY 1, 2, 3, 4"
SQL["method_breakdown"] = f"WITH {_STORED} SELECT method, count(*) AS n FROM st GROUP BY 1"
SQL["move_blocks"] = f"""WITH {_STORED}, f AS (SELECT *, CASE WHEN lag(sentence_id) OVER w IS NOT NULL AND move IS NOT DISTINCT FROM lag(move) OVER w AND step IS NOT DISTINCT FROM lag(step) OVER w THEN 0 ELSE 1 END AS new FROM st WINDOW w AS (PARTITION BY paper_id, section ORDER BY sentence_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY paper_id, section ORDER BY sentence_id ROWS UNBOUNDED PRECEDING) AS block FROM f)
SELECT paper_id, section, block, any_value(move) AS move, any_value(step) AS step, min(sentence_id) AS first_sentence, max(sentence_id) AS last_sentence, count(*) AS n_sentences, round(avg(confidence) + 1e-9, 3) AS avg_confidence FROM b GROUP BY 1, 2, 3"""
SQL["move_flow"] = f"""WITH {_STORED}, f AS (SELECT *, lag(sentence_id) OVER w IS NULL OR move IS DISTINCT FROM lag(move) OVER w AS keep FROM st WINDOW w AS (PARTITION BY paper_id, section ORDER BY sentence_id))
SELECT paper_id, section, string_agg(coalesce(move, 'Unclassified'), ' -> ' ORDER BY sentence_id) AS flow_pattern FROM f WHERE keep GROUP BY 1, 2"""


def _move_rules() -> str:
    tax = """CASE WHEN regexp_matches(s, 'introduction|\\bintro\\b') THEN 'introduction' WHEN regexp_matches(s, 'literature|related work|background|state of the art|theoretical framework|review') THEN 'literature_review'
 WHEN regexp_matches(s, 'discussion|conclusion|implication|closing remarks') THEN 'discussion' WHEN regexp_matches(s, 'method|material|experimental|procedure|design|data collection') THEN NULL ELSE 'introduction' END"""
    bonus = {("introduction", "M1"): "p <= 40|0.15", ("introduction", "M2"): "p > 30 AND p <= 70|0.15", ("introduction", "M3"): "p > 60|0.2", ("discussion", "M1"): "p <= 50|0.15", ("discussion", "M2"): "p > 40 AND p <= 80|0.1", ("discussion", "M3"): "p > 60|0.2", ("literature_review", "M1"): "p <= 30|0.15", ("literature_review", "M3"): "p > 70|0.15"}
    parts = []
    for o, (t, move, label, step, weight, cues) in enumerate(moves.LEXICON):
        hits = " + ".join(f"CAST(regexp_matches(l, {_q(c)}) AS INT)" for c in cues)
        when, add = (bonus.get((t, move)) or "false|0.0").split("|")
        cited = "CASE WHEN cited THEN 0.15 ELSE 0.0 END" if any(x in step for x in ("Reviewing", "Summarizing", "Comparing")) else "0.0"
        parts.append(f"SELECT sentence_id, {o} AS o, {_q(move + ': ' + label)} AS move, {_q(step)} AS step, ({hits}) AS h, least(1.0, least(1.0, CAST({hits} AS DOUBLE) * {weight} * 0.5) + CASE WHEN {when} THEN {add} ELSE 0.0 END + {cited}) AS score FROM base WHERE tax = '{t}'")
    return rf"""src AS (SELECT DISTINCT sentence_id, coalesce(section, '') AS section, text, position_pct AS p FROM sentences WHERE length(text) > 0),
 pre AS (SELECT *, lower(section) AS s, lower(text) AS l, regexp_matches(text, '\([A-Z][a-z]+.*?(19|20)\d{{2}}\)|[A-Z][a-z]+\s+(et\s+al\.?\s+)?\((19|20)\d{{2}}\)') OR regexp_matches(text, '\[\d+[,;\-\d\s]*\]') AS cited FROM src),
 base AS (SELECT *, {tax} AS tax FROM pre), scored AS ({" UNION ALL ".join(parts)}), best AS (SELECT sentence_id, arg_max(struct_pack(m := move, t := step, c := score), struct_pack(c := score, k := -o)) AS b FROM scored WHERE h > 0 GROUP BY 1)"""


SQL["move_rules"] = f"WITH {_move_rules()} SELECT base.sentence_id, tax AS taxonomy_type, b.m AS move_rule, b.t AS step_rule, coalesce(round(b.c, 3), 0.0) AS conf_rule FROM base LEFT JOIN best ON base.sentence_id = best.sentence_id"
SQL["move_reconcile"] = f"""WITH {_move_rules()}, st AS (SELECT DISTINCT sentence_id, move AS ml, step AS sl, confidence AS cl FROM sentences WHERE length(text) > 0), j AS (SELECT st.*, b.m[1:2] AS mr, b.t AS sr, coalesce(round(b.c, 3), 0.0) AS cr FROM st LEFT JOIN best ON st.sentence_id = best.sentence_id)
SELECT sentence_id, coalesce(ml, mr, 'Unclassified') AS move, CASE WHEN ml IS NOT NULL THEN sl ELSE sr END AS step, round(CASE WHEN mr = ml THEN least(1.0, (cr + cl) / 2 + 0.15) WHEN mr IS NOT NULL AND ml IS NOT NULL THEN cl * 0.85 WHEN ml IS NOT NULL THEN cl WHEN mr IS NOT NULL THEN cr ELSE 0.0 END, 3) AS confidence,
 CASE WHEN mr = ml THEN 'rule+llm' WHEN ml IS NOT NULL THEN 'llm' WHEN mr IS NOT NULL THEN 'rule' ELSE 'none' END AS method FROM j"""

# Layout ---------------------------------------------------------------------------
_TOL = f"""{BOXES}, ys AS (SELECT DISTINCT doc_id, page, y FROM boxes), gp AS (SELECT doc_id, page, y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY y) AS gap FROM ys), mid AS (SELECT doc_id, page, quantile_cont(gap, 0.5) AS mid FROM gp WHERE gap IS NOT NULL GROUP BY 1, 2),
 sm AS (SELECT g.doc_id, g.page, quantile_cont(gap, 0.5) AS m FROM gp g JOIN mid ON g.doc_id = mid.doc_id AND g.page = mid.page WHERE gap <= mid GROUP BY 1, 2), nn AS (SELECT doc_id, page, count(*) AS n FROM boxes GROUP BY 1, 2),
 tol AS (SELECT nn.doc_id, nn.page, CASE WHEN n < 10 THEN 4.0 ELSE coalesce(least(greatest(ceil(m * 1.5), 2), 8), 4.0) END AS tol FROM nn LEFT JOIN sm ON nn.doc_id = sm.doc_id AND nn.page = sm.page)"""
SQL["line_binning"] = f"WITH {_TOL} SELECT b.doc_id, b.page, round_even(y / tol, 0) * tol AS line_y, string_agg(text, ' ' ORDER BY x, word_ord) AS line, count(*) AS n_words FROM boxes b JOIN tol t ON b.doc_id = t.doc_id AND b.page = t.page GROUP BY 1, 2, 3"
_GUT = f"""{BOXES}, r AS (SELECT *, count(*) OVER w AS k, sum(x) OVER w AS s, count(*) OVER (PARTITION BY doc_id, page) AS n, sum(x) OVER (PARTITION BY doc_id, page) AS t FROM boxes WINDOW w AS (PARTITION BY doc_id, page ORDER BY x, word_ord ROWS UNBOUNDED PRECEDING)),
 sp AS (SELECT doc_id, page, arg_max(struct_pack(l := s / k, r := (t - s) / (n - k), n := n, k := k), struct_pack(sc := s * s / k + (t - s) * (t - s) / (n - k), x := x, k := k)) AS b FROM r WHERE k < n GROUP BY 1, 2),
 bins AS (SELECT doc_id, page, b, unnest(range(1, 50)) AS bin FROM sp),
 cnt AS (SELECT x.doc_id, x.page, CAST(least(floor((x.x - b.l) / ((b.r - b.l) / 49)) + 1, 49) AS INT) AS bin, count(*) AS m FROM boxes x JOIN sp ON x.doc_id = sp.doc_id AND x.page = sp.page WHERE x.x BETWEEN b.l AND b.r GROUP BY 1, 2, 3),
 bb AS (SELECT bins.doc_id, bins.page, any_value(b) AS b, min(struct_pack(m := coalesce(m, 0), bin := bins.bin)) AS best FROM bins LEFT JOIN cnt ON bins.doc_id = cnt.doc_id AND bins.page = cnt.page AND bins.bin = cnt.bin GROUP BY 1, 2),
 gut AS (SELECT doc_id, page, b.n AS n, b.k AS n_left, CASE WHEN b.n < 2 THEN (b.l + b.r) / 2 ELSE b.l + best.bin * (b.r - b.l) / 49 END AS threshold FROM bb)"""
SQL["column_gutter"] = f"WITH {_GUT} SELECT doc_id, page, round(threshold, 4) AS threshold FROM gut"

# Sources --------------------------------------------------------------------------
_LATEST = "SELECT paper_id, arg_max(struct_pack(doi, title, journal_title, publisher, publication_year, volume, issn, work_type, fetched_at), fetched_at) AS m FROM main_metadata GROUP BY 1"
SQL["index_metadata"] = f"SELECT paper_id AS doc_id, m.doi AS doi, m.title AS title, m.journal_title AS journal_title, m.publisher AS publisher, m.publication_year AS publication_year, m.volume AS volume, m.issn AS issn, m.work_type AS work_type FROM ({_LATEST})"
SQL["document_info"] = rf"""
SELECT paper_id AS doc_id, nullif(trim(m.title), '') AS title, NULL AS authors, nullif(trim(regexp_extract(coalesce(m.journal_title, '') || ', volume 1', '^(.*?)(?:,|\s+doi)', 1)), '') AS journal,
 coalesce(nullif(regexp_extract(coalesce(m.journal_title, ''), '((?:19|20)\d{{2}})', 1), ''), CAST(year(m.fetched_at) AS VARCHAR)) AS year, nullif(regexp_extract(coalesce(m.doi, ''), '10\.\d{{4,9}}/[-._;()/:A-Za-z0-9]+'), '') AS doi FROM ({_LATEST})"""
SQL["index_authors"] = """
WITH a AS (SELECT DISTINCT ON (author_id) author_id, paper_id, author_ord, given_name, family_name, orcid FROM authors)
SELECT a.paper_id AS doc_id, CAST(row_number() OVER (PARTITION BY a.paper_id ORDER BY author_ord, author_id) AS INT) AS author_ord, given_name, family_name, regexp_replace(orcid, '^https?://orcid\\.org/', '') AS orcid
FROM a WHERE paper_id IN (SELECT paper_id FROM main_metadata)"""
SQL["reference_titles"] = r"""
SELECT DISTINCT mapping_id, coalesce(nullif(trim(regexp_extract(ref_full_text, '\(\d{4}[a-z]?\)\.?\s*([^.]+)', 1)), ''), trim(regexp_split_to_array(ref_full_text, '\.\s')[2])) AS title FROM matched_citations WHERE ref_full_text IS NOT NULL"""
_CITES = "cites AS (SELECT paper_id AS doc_id, CAST(mapping_id AS VARCHAR) AS citation_id, min(struct_pack(a := citation_type, b := citation_text, c := citation_text_clean)) AS c FROM matched_citations WHERE citation_text IS NOT NULL GROUP BY 1, 2)"
SQL["match_numbered"] = rf"""WITH {_CITES}, n AS (SELECT doc_id, citation_id, regexp_extract_all(c.b, '\d+') AS ns FROM cites WHERE c.a LIKE 'numbered\_%' ESCAPE '\'),
 u AS (SELECT doc_id, citation_id, unnest(range(len(ns))) AS number_ord, unnest(ns) AS number FROM n UNION ALL SELECT doc_id, citation_id, 0, NULL FROM n WHERE len(ns) = 0),
 r AS (SELECT DISTINCT paper_id AS doc_id, matched_ref_id AS ref_id FROM matched_citations WHERE matched_ref_id IS NOT NULL)
SELECT u.doc_id, citation_id, number_ord, ref_id AS matched_ref_id, CASE WHEN number IS NULL THEN 'no_match_missing_number' WHEN ref_id IS NULL THEN 'no_match_numbered' ELSE 'high_numbered' END AS match_confidence
FROM u LEFT JOIN r ON u.doc_id = r.doc_id AND r.ref_id = 'REF_' || CAST(CAST(number AS BIGINT) AS VARCHAR)"""

# Words, clusters and networks of other forms -----------------------------------------
SQL["word_top20"] = f"SELECT * FROM ({SQL['word_frequencies']}) WHERE rank <= 20"
_cut = lambda k: f"CASE WHEN length(text) > {k} THEN substring(text, 1, {k - 3}) || '...' ELSE text END AS upto_{k}"
SQL["text_previews"] = f"SELECT DISTINCT sentence_id, {_cut(25)}, {_cut(200)}, {_cut(20)} FROM sentences WHERE text IS NOT NULL"
_TITLE = r"coalesce(nullif(trim(regexp_extract(ref_full_text, '\(\d{4}[a-z]?\)\.?\s*([^.]+)', 1)), ''), trim(regexp_split_to_array(ref_full_text, '\.\s')[2]))"
_CLUSTER = f"""c AS (SELECT DISTINCT paper_id, mapping_id, citation_text_clean, ref_full_text FROM matched_citations WHERE citation_text_clean IS NOT NULL),
 pl AS (SELECT DISTINCT paper_id, citation_text_clean, [{', '.join(map(_q, PARTS))}][ntile({len(PARTS)}) OVER (PARTITION BY paper_id ORDER BY mapping_id, citation_text_clean, ref_full_text NULLS FIRST)] AS section FROM c),
 cited AS (SELECT DISTINCT pl.paper_id, section, ref_full_text FROM pl JOIN c ON pl.paper_id = c.paper_id AND pl.citation_text_clean = c.citation_text_clean WHERE ref_full_text IS NOT NULL),
 titled AS (SELECT *, {_TITLE} AS title FROM cited),
 tw AS (SELECT paper_id, section, ref_full_text, list_filter(regexp_extract_all(lower(title), '{_W}'), lambda w: length(w) >= 3 AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN {_STOP}) AS ws FROM titled WHERE length(title) > 0),
 a AS (SELECT * FROM tw), {_grams('paper_id, section', (1, 2))}, terms AS (SELECT paper_id, section, ngram, sum(1) AS n FROM g GROUP BY 1, 2, 3),"""
_CLUSTER_TOP = _CLUSTER + _TFIDF.partition("tot AS")[1] + _TFIDF.partition("tot AS")[2]
SQL["cluster_terms"] = f"WITH {_CLUSTER_TOP}, top AS (SELECT * FROM (SELECT paper_id, section, ngram, n, tf, idf, tf_idf, row_number() OVER (PARTITION BY paper_id, section ORDER BY tf_idf DESC, ngram) AS rank FROM tfidf) WHERE rank <= 10) SELECT * FROM top"
SQL["cluster_references"] = f"""WITH {_CLUSTER_TOP}, {_TOP(10)}, nr AS (SELECT paper_id, section, count(DISTINCT ref_full_text) AS n_references FROM cited GROUP BY 1, 2)
SELECT t.paper_id, t.section, n_references, top_terms FROM (SELECT paper_id, section, string_agg(ngram, ', ' ORDER BY rank) AS top_terms FROM top GROUP BY 1, 2) t LEFT JOIN nr ON t.paper_id = nr.paper_id AND t.section = nr.section"""
SQL["citation_subsets"] = f"WITH {_HITS} " + " UNION ALL ".join(f"SELECT doc_id, '{name}' AS subset, citation_type, count(*) AS n FROM hits WHERE citation_type IN ({', '.join(map(_q, own))}) GROUP BY 1, 2, 3" for name, own in SUBSETS.items() if name != "all")
_GROUPED = _WITH.replace(PAPERS, GROUPED)
SQL["citation_complex"] = f"{_GROUPED}{_EXP} SELECT doc_id, original_complex_citation, count(*) AS individual_citations_extracted FROM expanded WHERE citation_type = 'parsed_from_multiple' GROUP BY 1, 2"
SQL["citation_expand_groups"] = f"{_GROUPED}{_EXP} SELECT * FROM expanded"
SQL["network_sections"] = f"{_WITH}{_PAIRS}{_EDGES}{_PARTS}{_NODES} SELECT doc_id, primary_section AS section, count(*) AS n_nodes FROM nodes GROUP BY 1, 2"
SQL["name_letters"] = rf"""WITH c AS (SELECT DISTINCT cite_author, regexp_extract(ref_authors, '(\p{{Lu}}[\p{{L}}''-]{{2,}})', 1) AS ref_name FROM matched_citations WHERE ref_authors IS NOT NULL AND cite_author IS NOT NULL),
n AS (SELECT cite_author, ref_name, list_distinct(string_split({_normal('cite_author')}, '')) AS x, list_distinct(string_split({_normal('ref_name')}, '')) AS y FROM c WHERE length(ref_name) > 0)
SELECT cite_author, ref_name, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 4) AS share FROM n"""

# References of a paper, of an index, of works -------------------------------------------
SQL["references_split"] = f"WITH {_REFS}, k AS (SELECT doc_id, ref_full_text, ref_ord FROM prefs WHERE length(trim(ref_full_text)) >= 15) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ref_ord) AS INT) AS ref_ord, trim(ref_full_text) AS ref_full_text FROM k"
_INDEX = """ir AS (SELECT ref_row_id, r.*, row_number() OVER (PARTITION BY r.paper_id ORDER BY ref_row_id) AS ref_ord FROM (SELECT ref_row_id, min(struct_pack(paper_id := paper_id, author := author, ref_year := ref_year, article_title := article_title, journal := journal, doi := doi, ref_full := ref_full)) AS r FROM crossref_refs GROUP BY 1))"""
_part = lambda c, a, b: f"CASE WHEN {c} IS NOT NULL THEN '{a}' || {c} || '{b}' ELSE '' END"
SQL["reference_from_index"] = rf"""WITH {_INDEX}, w AS (SELECT *, regexp_extract_all(author, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS ts FROM ir),
x AS (SELECT *, CASE WHEN author IS NULL THEN NULL ELSE array_to_string(list_transform(range(1, len(ts) + 1), lambda i: CASE WHEN regexp_matches(ts[i], '^[A-Z]+$') THEN '' WHEN i > 1 AND regexp_matches(ts[i - 1], '^[A-Z]+$') THEN regexp_replace(ts[i], '^\s+', '') ELSE ts[i] END), '') END AS kept FROM w),
y AS (SELECT *, array_to_string(list_transform(string_split(lower(trim(kept)), ' '), lambda v: upper(v[1]) || v[2:]), ' ') AS first FROM x)
SELECT paper_id AS doc_id, ref_ord, 'REF_' || ref_ord AS ref_id, ref_full AS ref_full_text, author AS ref_authors, ref_year, journal AS ref_journal, first AS ref_first_author, lower(first) AS ref_first_author_normalized,
 CASE WHEN contains(ref_full, '(') THEN CAST(floor((len(string_split(regexp_extract(ref_full, '^(.*?)\s*\(', 1), ',')) - 1 + 1) / 2) AS INT) END AS n_authors, doi,
 trim(regexp_replace({_part('author', '', ',')} || ' ' || {_part('ref_year', '(', '),')} || ' ' || {_part('article_title', '', '.')} || ' ' || {_part('journal', '', '.')}, '\s+', ' ', 'g')) AS ref_full_text2, 'crossref' AS ref_source FROM y"""
_WORKS = """works AS (SELECT m.m.doi AS doi, m.paper_id AS work_id, m.m.title AS title, m.m.publication_year AS publication_year, m.m.journal_title AS source, a.names FROM
  (SELECT paper_id, arg_max(struct_pack(doi := doi, title := title, publication_year := publication_year, journal_title := journal_title), struct_pack(a := fetched_at, b := doi, c := title, d := publication_year, e := journal_title)) AS m FROM main_metadata GROUP BY 1) m
  LEFT JOIN (SELECT paper_id, list(name ORDER BY author_ord NULLS FIRST, author_id) AS names FROM (SELECT author_id, a.paper_id AS paper_id, a.author_ord AS author_ord, trim(concat_ws(' ', a.given_name, a.family_name)) AS name FROM
   (SELECT author_id, min(struct_pack(paper_id := paper_id, author_ord := author_ord, given_name := given_name, family_name := family_name)) AS a FROM authors WHERE family_name IS NOT NULL GROUP BY 1)) GROUP BY 1) a ON m.paper_id = a.paper_id)"""
_PARTICLES = "['van', 'von', 'de', 'di', 'da', 'del', 'della', 'le', 'la', 'du', 'des']"
_at = lambda w: f"coalesce(nullif(list_position(list_transform({w}[1:len({w}) - 1], lambda z: list_contains({_PARTICLES}, lower(z))), true), 0), len({w}))"
_sur = lambda w: f"array_to_string({w}[{_at(w)}:len({w})], ' ')"
SQL["works_citations"] = rf"""WITH {_WORKS}, w AS (SELECT *, list_transform(coalesce(names, []), lambda n: regexp_split_to_array(trim(n), '\s+')) AS ws FROM works)
SELECT doi, work_id, len(ws) AS n_authors, CASE WHEN len(ws) > 0 THEN {_sur('ws[1]')} END AS first_author,
 CASE WHEN len(ws) > 0 THEN array_to_string(list_transform(ws, lambda v: {_sur('v')} || CASE WHEN {_at('v')} > 1 THEN ', ' || array_to_string(list_transform(v[1:{_at('v')} - 1], lambda u: u[1]), '.') || '.' ELSE '' END), ', ') ELSE 'Unknown' END || ' (' || coalesce(CAST(publication_year AS VARCHAR), 'n.d.') || ') ' ||
 CASE WHEN length(trim(title)) > 0 THEN title ELSE 'Untitled' END || ', ' || CASE WHEN length(trim(source)) > 0 THEN source ELSE 'Unknown source' END || '.' AS ref_full_name FROM w"""
_SURNAME = r"(?:(?:de|van|von|di|da|del|della|der|den|la|le|ten|du)\s+)*[A-ZÀ-ÞŠŽŁØ][\p{L}''-]+"


def _author_sql(a: str) -> dict[str, str]:
    s = rf"trim(regexp_replace({a}, '^\[?\d+\]?\.?\s*', ''))"
    first = rf"nullif(regexp_extract({s}, '^({_SURNAME})', 1), '')"
    n = rf"CASE WHEN length({s}) = 0 THEN NULL WHEN regexp_matches({s}, 'et\s+al') THEN 99 ELSE greatest(len(regexp_extract_all({s}, '[A-ZÀ-Þ]\.(?:\s*-?[A-ZÀ-Þ]\.)*')), 1) END"
    second = rf"CASE WHEN {n} >= 2 THEN nullif(regexp_extract({s}, '[A-ZÀ-Þ]\.(?:\s*[A-ZÀ-Þ]\.)*\s*[,&]\s*&?\s*({_SURNAME})', 1), '') END"
    return {"first": first, "second": second, "n": n}


def _lettered(x: str) -> str:
    return f"regexp_replace({_plain(f'lower({x})')}, '[^a-z'' -]', '', 'g')"


_Y4 = r"regexp_extract(ref_year, '^(\d{4})', 1)"
_YEARED = "yeared AS (SELECT r.*, ys.ref_format, ys.ref_year FROM prefs r JOIN (" + SQL["reference_years"].replace("WITH " + _REFS + ",", "WITH ") + ") ys ON r.doc_id = ys.doc_id AND r.ref_ord = ys.ref_ord)"
_A = _author_sql("ref_authors")
SQL["reference_parse"] = rf"""WITH {_REFS}, {_YEARED},
p AS (SELECT *, {_Y4} AS bare, strpos(ref_full_text, '(' || {_Y4}) AS at_paren, strpos(ref_full_text, {_Y4}) AS at_year FROM yeared),
q AS (SELECT *, coalesce(CASE WHEN ref_format = 'author_year_paren' AND at_paren > 0 THEN trim(substring(ref_full_text, 1, at_paren - 1)) WHEN at_year > 0 THEN trim(regexp_replace(substring(ref_full_text, 1, at_year - 1), '[,&\s(]+$', '')) END, trim(regexp_extract(ref_full_text, '^([^.]{{0,200}})', 1))) AS ref_authors FROM p),
t AS (SELECT *, strpos(ref_full_text, ref_year) AS after, regexp_replace(substring(ref_full_text, strpos(ref_full_text, ref_year) + length(ref_year)), '^\)?\.?\s*', '') AS rest FROM q)
SELECT doc_id, ref_ord, 'REF_' || ref_ord AS ref_id, ref_full_text, ref_format, ref_authors, ref_year, {_A['first']} AS ref_first_author, {_lettered(_A['first'])} AS ref_first_author_normalized, {_A['second']} AS ref_second_author, {_lettered(_A['second'])} AS ref_second_author_normalized, {_A['n']} AS n_authors,
 CASE WHEN ref_year IS NOT NULL AND after > 0 THEN trim(coalesce(nullif(regexp_extract(rest, '^(.*?)(?:\.\s+[A-Z]|\d+\s*\(\d+\))', 1), ''), regexp_extract(rest, '^([^.]+)', 1))) END AS ref_title,
 nullif(regexp_replace(regexp_extract(ref_full_text, '(10\.\d{{4,}}/[^\s,]+)', 1), '[.,;)]+$', ''), '') AS ref_doi FROM t"""
_B = _author_sql("r.b")
_OWN = rf"""own AS (SELECT doc_id, ref_id, TRY_CAST(nullif(regexp_extract(ref_id, '(\d+)', 1), '') AS INT) AS ref_ord, r.a2 AS ref_full_text, r.c AS ref_year, lower(regexp_extract(r.b, '(\p{{Lu}}[\p{{L}}''-]{{2,}})', 1)) AS ref_first_author, lower({_B['second']}) AS ref_second_author, {_B['n']} AS n_authors FROM
  (SELECT paper_id AS doc_id, matched_ref_id AS ref_id, min(struct_pack(a1 := mapping_id, a2 := ref_full_text, b := ref_authors, c := ref_year)) AS r FROM matched_citations WHERE matched_ref_id IS NOT NULL GROUP BY 1, 2))"""
SQL["citation_drop_beyond"] = rf"""{_WITH}, {_OWN}, n AS (SELECT doc_id, count(*) AS k FROM own GROUP BY 1)
SELECT s.doc_id, citation_id, citation_text FROM swept s LEFT JOIN n ON s.doc_id = n.doc_id WHERE NOT coalesce(citation_type LIKE 'numbered\_%' ESCAPE '\' AND len(list_filter(regexp_extract_all(citation_text, '\d+'), lambda x: TRY_CAST(x AS INT) > k)) > 0, false)"""
_AUTH = r"regexp_extract(author, '(\p{Lu}[\p{L}''-]{2,})', 1)"
SQL["reference_enrich"] = rf"""WITH {_INDEX}, {_OWN}, i AS (SELECT paper_id AS doc_id, CAST(ref_row_id AS VARCHAR) AS ref_id, ref_full AS ref_full_text, ref_year, {_AUTH} AS ref_first_author FROM ir),
h AS (SELECT i.doc_id, i.ref_id, o.ref_full_text AS page_text, o.ref_second_author AS page_second, o.n_authors AS page_n, row_number() OVER (PARTITION BY i.doc_id, i.ref_id ORDER BY ref_ord NULLS FIRST) AS k FROM i JOIN own o ON i.doc_id = o.doc_id AND regexp_extract(i.ref_year, '^(\d{{4}})', 1) = regexp_extract(o.ref_year, '^(\d{{4}})', 1)
 WHERE coalesce(length(i.ref_full_text), 0) <= 60 AND (lower(i.ref_first_author) = lower(o.ref_first_author) OR contains(lower(i.ref_first_author), lower(o.ref_first_author)) OR contains(lower(o.ref_first_author), lower(i.ref_first_author))))
SELECT i.doc_id, i.ref_id, CASE WHEN length(page_text) > coalesce(length(ref_full_text), 0) THEN page_text ELSE ref_full_text END AS ref_full_text, ref_first_author, ref_year, page_second AS ref_second_author, page_n AS n_authors, page_text IS NOT NULL AS enriched FROM i LEFT JOIN h ON i.doc_id = h.doc_id AND i.ref_id = h.ref_id AND k = 1"""
_same = lambda x, y: f"(length({x}) > 0 AND length({y}) > 0 AND ({x} = {y} OR contains({x}, {y}) OR contains({y}, {x}) OR (length({x}) = length({y}) AND len(list_filter(range(1, length({x}) + 1), lambda i: {x}[i] <> {y}[i])) <= CASE WHEN length({x}) > 5 THEN 2 ELSE 1 END) OR (least(length({x}), length({y})) / greatest(length({x}), length({y})) >= 0.7 AND 1 - levenshtein({x}, {y}) / greatest(length({x}), length({y})) >= 0.8)))"
SQL["works_completion"] = rf"""WITH {_INDEX}, r AS (SELECT *, nullif({_AUTH}, '') AS first, lower(trim(regexp_replace(doi, '^(https?://(dx\.)?doi\.org/|doi:\s*)', ''))) AS k FROM ir WHERE doi IS NOT NULL),
w AS (SELECT k, arg_min(struct_pack(id := ref_row_id, title := article_title, y := CAST(nullif(regexp_extract(ref_year, '(\d{{4}})', 1), '') AS INT), src := journal, first := first), ref_row_id) AS w FROM r WHERE length(trim(doi)) > 0 GROUP BY 1),
j AS (SELECT r.*, w.w AS w, {_normal('r.first')} AS x, {_normal('w.w.first')} AS z FROM r LEFT JOIN w ON r.k = w.k),
v AS (SELECT *, w IS NOT NULL AND NOT coalesce(first IS NOT NULL AND w.first IS NOT NULL AND length(trim(first)) > 0 AND length(trim(w.first)) > 0 AND NOT {_same('x', 'z')}, false) AS wins FROM j)
SELECT paper_id AS doc_id, ref_row_id AS ref_id, doi, CASE WHEN wins THEN coalesce(w.first, first) ELSE first END AS ref_first_author, CASE WHEN wins THEN coalesce(CAST(w.y AS VARCHAR), ref_year) ELSE coalesce(ref_year, CAST(w.y AS VARCHAR)) END AS ref_year,
 CASE WHEN wins THEN coalesce(w.src, journal) ELSE coalesce(journal, w.src) END AS ref_journal, NULL AS n_authors, CASE WHEN w IS NOT NULL THEN concat_ws('. ', w.first, w.title, w.src) END AS ref_full_text2, CASE WHEN wins THEN 'works' WHEN w IS NOT NULL THEN 'gaps' ELSE 'none' END AS completed_by FROM v"""

# Matching -----------------------------------------------------------------------------
_PARTICLE_NAME = r"^((?:[Dd]i|[Dd]e|[Vv]an|[Vv]on|[Dd]er|[Dd]en|[Ll]a|[Ll]e|[Dd]el|[Dd]ella)\s+[\p{L}''-]+)"
_surname_of = lambda x: rf"coalesce(nullif(regexp_extract({x}, '{_PARTICLE_NAME}', 1), ''), nullif(regexp_extract({x}, '^([\p{{L}}''-]+)', 1), ''))"


def _narrative(cites: str) -> str:
    """CTE ``narr`` from citations (doc_id, citation_id, citation_type, clean) and ``own`` references."""
    return rf"""i0 AS (SELECT doc_id, citation_id, trim(regexp_replace(regexp_replace(clean, '^\(|\)$', '', 'g'), '^\(?(see|e\.g\.|cf\.|i\.e\.|viz\.|compare)\s+', '')) AS s FROM {cites} WHERE citation_type NOT LIKE 'numbered\_%' ESCAPE '\'),
 i1 AS (SELECT *, {_surname_of('s')} AS cite_author, nullif(regexp_extract(s, '(\d{{4}}[a-z]?)', 1), '') AS cite_year, regexp_matches(s, 'et\s+al\.') AS cite_has_etal, trim(regexp_extract(s, '(?:and|&)\s+(\p{{L}}[\p{{L}}\s''-]+?)(?:,|\s+\()', 1)) AS aft FROM i0),
 i2 AS (SELECT *, CASE WHEN regexp_matches(s, '\s+and\s+|\s+&\s+') AND NOT cite_has_etal AND length(aft) > 0 THEN lower({_surname_of('aft')}) END AS cite_second_author, lower(cite_author) AS a, regexp_replace(cite_year, '[a-z]$', '') AS bare FROM i1),
 m0 AS (SELECT i.*, r.ref_id, r.ref_ord, r.ref_year, lower(r.ref_first_author) AS r1, lower(r.ref_second_author) AS r2, r.n_authors, CASE WHEN r.ref_year = cite_year THEN 0 WHEN r.ref_year = bare THEN 1 END AS yt FROM i2 i JOIN own r ON i.doc_id = r.doc_id AND i.bare = regexp_replace(r.ref_year, '[a-z]$', '') WHERE a IS NOT NULL AND cite_year IS NOT NULL),
 m1 AS (SELECT * FROM (SELECT *, min(yt) OVER (PARTITION BY doc_id, citation_id) AS by_ FROM m0 WHERE yt IS NOT NULL) WHERE yt = by_),
 m2 AS (SELECT *, CASE WHEN a = r1 THEN 0 WHEN {_plain('a')} = {_plain('r1')} THEN 1 WHEN contains({_plain('a')}, {_plain('r1')}) OR contains({_plain('r1')}, {_plain('a')}) THEN 2 END AS at_ FROM m1),
 m3 AS (SELECT * FROM (SELECT *, min(at_) OVER (PARTITION BY doc_id, citation_id) AS ba FROM m2) WHERE at_ = ba),
 m4 AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY doc_id, citation_id ORDER BY ref_id) AS by_id, row_number() OVER (PARTITION BY doc_id, citation_id ORDER BY ref_ord NULLS FIRST) AS by_ord, sum(coalesce(CAST(r2 = cite_second_author AS INT), 0)) OVER w AS n2, sum(coalesce(CAST(n_authors >= 3 AS INT), 0)) OVER w AS n3, CASE WHEN regexp_matches(cite_year, '[a-z]$') THEN ascii(cite_year[-1]) - 96 END AS ix FROM m3 WINDOW w AS (PARTITION BY doc_id, citation_id)),
 m5 AS (SELECT *, CASE WHEN n = 1 AND cite_has_etal AND n_authors < 3 THEN 'medium_etal_inconsistent' WHEN n = 1 THEN 'high' WHEN ix IS NOT NULL AND ix <= n THEN 'high_suffix_disambiguated' WHEN ix IS NOT NULL THEN 'medium_suffix_out_of_range' WHEN n2 = 1 THEN 'high_second_author' WHEN n2 > 1 THEN 'medium_multiple_with_second' WHEN cite_has_etal AND n3 > 0 THEN 'medium_etal_heuristic' WHEN cite_has_etal THEN 'medium_crossref_etal' ELSE 'medium_multiple_matches' END AS label,
  CASE WHEN n = 1 THEN 0 WHEN ix IS NOT NULL THEN CASE WHEN by_id = least(ix, n) THEN 0 ELSE 1 END WHEN n2 > 0 THEN CASE WHEN coalesce(r2 = cite_second_author, false) THEN by_ord ELSE 1073741824 END WHEN cite_has_etal AND n3 > 0 THEN 1048576 - coalesce(n_authors, 0) ELSE by_ord END AS o FROM m4),
 m6 AS (SELECT doc_id, citation_id, ref_id, label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, citation_id ORDER BY o, by_ord) AS pick FROM m5) WHERE pick = 1),
 my AS (SELECT DISTINCT doc_id, citation_id FROM m1),
 narr AS (SELECT i.doc_id, i.citation_id, cite_author, cite_second_author, cite_year, cite_has_etal, m6.ref_id AS matched_ref_id, CASE WHEN a IS NULL OR cite_year IS NULL THEN 'no_match_missing_info' WHEN my.doc_id IS NULL THEN 'no_match_year' WHEN label IS NULL THEN 'no_match_author' ELSE label END AS match_confidence FROM i2 i LEFT JOIN m6 ON i.doc_id = m6.doc_id AND i.citation_id = m6.citation_id LEFT JOIN my ON i.doc_id = my.doc_id AND i.citation_id = my.citation_id)"""


def _numbered(cites: str) -> str:
    """CTE ``numb`` from citations (doc_id, citation_id, citation_type, citation_text) and ``own`` references."""
    return rf"""nn0 AS (SELECT doc_id, citation_id, regexp_extract_all(citation_text, '\d+') AS ns FROM {cites} WHERE citation_type LIKE 'numbered\_%' ESCAPE '\'),
 nn1 AS (SELECT doc_id, citation_id, unnest(ns) AS number FROM nn0 UNION ALL SELECT doc_id, citation_id, NULL FROM nn0 WHERE len(ns) = 0),
 numb AS (SELECT n.doc_id, n.citation_id, o.ref_id AS matched_ref_id, CASE WHEN number IS NULL THEN 'no_match_missing_number' WHEN o.ref_id IS NULL THEN 'no_match_numbered' ELSE 'high_numbered' END AS match_confidence FROM nn1 n LEFT JOIN own o ON n.doc_id = o.doc_id AND o.ref_id = 'REF_' || regexp_replace(number, '^0+(.)', '\1'))"""


_MC = f"{_CITES}, mc AS (SELECT doc_id, citation_id, c.a AS citation_type, c.b AS citation_text, c.c AS clean FROM cites), {_OWN}, {_narrative('mc')}, {_numbered('mc')}"
SQL["match_narrative"] = f"WITH {_MC} SELECT * FROM narr"
SQL["match_quality"] = f"WITH {_MC}, b AS (SELECT match_confidence FROM narr UNION ALL SELECT match_confidence FROM numb) SELECT match_confidence, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 1) AS percentage FROM b GROUP BY 1"
_MAPPED = f"""{_EXP}{_STD}, sc AS (SELECT doc_id, citation_id, citation_type, citation_text, start_pos, end_pos, coalesce('(' || trim(author_part) || ', ' || translate(year_part, '()', '') || ')', citation_text) AS clean FROM std), {_OWN}, {_narrative('sc')}, {_numbered('sc')},
 mapped AS (SELECT b.*, own.ref_full_text FROM (SELECT doc_id, citation_id, matched_ref_id, match_confidence FROM narr UNION ALL SELECT * FROM numb) b LEFT JOIN own ON b.doc_id = own.doc_id AND b.matched_ref_id = own.ref_id),
 st AS (SELECT DISTINCT doc_id, start_pos FROM sc), sn AS (SELECT DISTINCT doc_id, end_pos FROM sc), fo AS (SELECT sn.doc_id, sn.end_pos, min(st.start_pos) AS following FROM sn LEFT JOIN st ON sn.doc_id = st.doc_id AND st.start_pos > sn.end_pos GROUP BY 1, 2),
 cx AS (SELECT s.*, regexp_extract_all(substring(t, 1, s.start_pos - 1), '{_W}') AS b, regexp_extract_all(substring(t, s.end_pos + 1, coalesce(following - s.end_pos - 1, length(t))), '{_W}') AS a FROM sc s JOIN sq ON s.doc_id = sq.doc_id JOIN fo ON s.doc_id = fo.doc_id AND s.end_pos = fo.end_pos)"""
SQL["contexts_matched"] = f"{_WITH}{_MAPPED} SELECT x.doc_id, x.citation_id, array_to_string(b[greatest(len(b) - 9, 1):len(b)], ' ') AS words_before, array_to_string(a[1:10], ' ') AS words_after, len(b) + len(a) AS context_word_count, matched_ref_id, ref_full_text, match_confidence FROM cx x LEFT JOIN mapped m ON x.doc_id = m.doc_id AND x.citation_id = m.citation_id"
SQL["analysis_summary"] = rf"""{_WITH}{_MAPPED}, tk AS (SELECT doc_id, count(*) AS n, count(DISTINCT word) AS u FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_W}')) AS word FROM papers) WHERE length(word) >= 3 AND NOT regexp_matches(word, '^[0-9]+$') GROUP BY 1),
 kc AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN citation_type LIKE '%narrative%' THEN 1 ELSE 0 END) AS nar, sum(CASE WHEN citation_type = 'parsed_from_multiple' THEN 1 ELSE 0 END) AS mul FROM sc GROUP BY 1), ln AS (SELECT doc_id, round(avg(len(a) + len(b)), 4) AS l FROM cx GROUP BY 1),
 rp AS (SELECT doc_id, count(*) AS n FROM own GROUP BY 1), lb AS (SELECT doc_id, match_confidence, count(*) AS k, sum(count(*)) OVER (PARTITION BY doc_id) AS al FROM mapped GROUP BY 1, 2),
 qu AS (SELECT doc_id, sum(CASE WHEN match_confidence IN ('high', 'high_second_author', 'medium_multiple_matches', 'medium_fuzzy') THEN k ELSE 0 END) AS good, string_agg(match_confidence || ' ' || k || ' ' || round(k / al * 100, 1), '; ' ORDER BY match_confidence) AS q FROM lb GROUP BY 1)
SELECT sq.doc_id, coalesce(tk.n, 0) AS total_words_analyzed, coalesce(tk.u, 0) AS unique_words, coalesce(kc.n, 0) AS citations_extracted, coalesce(nar, 0) AS narrative_citations, coalesce(kc.n, 0) - coalesce(nar, 0) AS parenthetical_citations, coalesce(mul, 0) AS complex_citations_parsed, round(tk.u / tk.n, 6) AS lexical_diversity,
 coalesce(l, 0.0) AS average_citation_context_length, round(coalesce(kc.n, 0) / len(regexp_split_to_array(t, '\s+')) * 1000, 2) AS citation_density_per_1000_words, coalesce(rp.n, 0) AS references_parsed, coalesce(good, 0) AS citations_matched_to_refs, q AS match_quality, 'all' AS citation_type_used
FROM sq LEFT JOIN tk ON sq.doc_id = tk.doc_id LEFT JOIN kc ON sq.doc_id = kc.doc_id LEFT JOIN ln ON sq.doc_id = ln.doc_id LEFT JOIN rp ON sq.doc_id = rp.doc_id LEFT JOIN qu ON sq.doc_id = qu.doc_id"""

# Sections -----------------------------------------------------------------------------
_ESC = r"regexp_replace(name, '([.|?*+^$()\[\]{}\\])', '\\\1', 'g')"


def _sections(source: str, names: str) -> str:
    """CTE ``secs`` (doc_id, section_ord, section, text) from ``source`` (doc_id, t) and ``names`` (doc_id, i, name)."""
    hit = lambda p, k: f"regexp_extract(t, '{p[0]}' || {_ESC} || '{p[1]}', {k})"
    strict = (r"(?is)^(.*?)(\n\n(?:[0-9]+(?:\.[0-9]+)*\.?\s*(?:\n\n|\|\s*))?", r")[\s.:]")
    loose = (r"(?is)^(.*?)(\n\s*(?:[0-9]+(?:\.[0-9]+)*\.?\s*\|?\s+)?", r")[\s.:]")
    tries = []
    for k, name in enumerate(se.REFERENCE_NAMES):
        for j, p in enumerate(se.REFERENCE_PATTERNS):
            tries.append((k * 10 + j, name, p.format(name).replace(r"\s+(?=[A-Z][a-z])", r"\s+")))
    # a looked-ahead capital is tested on what follows the last match instead
    last = " UNION ALL ".join(
        f"SELECT doc_id, {o} AS o, '{'Bibliography' if name.lower().startswith('b') else 'References'}' AS name, t, hs, gs, {len(p)} AS x FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS hs, regexp_split_to_array(t, '{p}') AS gs FROM {source} WHERE contains(t, '{name}'))" for o, name, p in tries
    )
    return rf"""sn0 AS (SELECT n.doc_id, i, name, t, {hit(strict, 1)} AS sa, {hit(strict, 2)} AS sb, {hit(loose, 1)} AS la, {hit(loose, 2)} AS lb FROM {names} n JOIN {source} d ON n.doc_id = d.doc_id WHERE contains(lower(t), lower(name))),
 sn1 AS (SELECT doc_id, i, name, CASE WHEN sb <> '' THEN 0 ELSE 1 END AS pass, CASE WHEN sb <> '' THEN length(sa) + 1 ELSE length(la) + 1 END AS sp, CASE WHEN sb <> '' THEN length(sb) ELSE length(lb) END AS sz FROM sn0 WHERE sb <> '' OR lb <> ''),
 er0 AS ({last}), er1 AS (SELECT doc_id, o, name, t, length(t) - length(gs[-1]) - length(hs[-1]) + 1 AS sp, length(hs[-1]) AS sz FROM er0 WHERE len(hs) > 0),
 er2 AS (SELECT doc_id, arg_min(struct_pack(name := name, sp := sp, sz := sz), o) AS e FROM er1 WHERE sp > length(t) * 0.5 AND regexp_matches(substring(t, sp + sz, 301), '^\s*[A-Z][a-zÀ-ÿ]|^\s*\[?\d+\]?[.\s]|^\s*\d+\.\s') AND (o % 10 <> 4 OR regexp_matches(substring(t, sp + sz, 2), '^[A-Z][a-z]')) GROUP BY 1),
 hd AS (SELECT * FROM sn1 UNION ALL SELECT doc_id, 0, e.name, 2, e.sp, e.sz FROM er2 WHERE doc_id NOT IN (SELECT doc_id FROM sn1 WHERE name IN ('References', 'REFERENCES', 'Bibliography', 'BIBLIOGRAPHY'))),
 od AS (SELECT hd.*, t, row_number() OVER w AS k, lead(sp) OVER w AS nx, min(sp) OVER (PARTITION BY hd.doc_id) AS f FROM hd JOIN {source} d ON hd.doc_id = d.doc_id WINDOW w AS (PARTITION BY hd.doc_id ORDER BY sp, pass, i)),
 bd AS (SELECT doc_id, k, name, regexp_replace(substring(t, sp + sz, greatest(coalesce(nx, length(t) + 1) - sp - sz, 0)), '^\s+|\s+$', '', 'g') AS text FROM od UNION ALL SELECT DISTINCT doc_id, 0, 'Preface', regexp_replace(substring(t, 1, f - 1), '^\s+|\s+$', '', 'g') FROM od WHERE f > 100 AND length(regexp_replace(substring(t, 1, f - 1), '^\s+|\s+$', '', 'g')) > 50),
 kp AS (SELECT *, count(*) FILTER (name = 'References') OVER (PARTITION BY doc_id) AS hasr FROM bd WHERE length(text) > 0),
 secs AS (SELECT doc_id, 0 AS section_ord, 'Full_text' AS section, t AS text FROM {source} UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN name = 'Bibliography' AND hasr = 0 THEN 1 ELSE 0 END, k), CASE WHEN name = 'Bibliography' AND hasr = 0 THEN 'References' ELSE name END, text FROM kp)"""


_AS_PAPERS = r"""ap AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?m)^==([^=]+)==\s*$', E'\n\n2. Results\n', 'g'), '(?m)^===+([^=]+)===+\s*$', E'\n3 Discussion: ', 'g') || E'\n\nConclusions. It was.' || CASE WHEN doc_id % 2 = 0 THEN E'\n\nBibliography\n[1] Smith, J.' ELSE ' so it ends. References Smith, J. and others' END AS t FROM documents WHERE length(text) > 0)"""
_DEFAULT = f"dn AS (SELECT doc_id, unnest(range({len(se.SECTION_NAMES)})) AS i, unnest([{', '.join(map(_q, se.SECTION_NAMES))}]) AS name FROM ap)"
SQL["section_split"] = f"WITH {_AS_PAPERS}, {_DEFAULT}, {_sections('ap', 'dn')} SELECT doc_id, section_ord, section, length(text) AS n_chars FROM secs"
SQL["section_exclusion"] = f"WITH {_AS_PAPERS}, {_DEFAULT}, {_sections('ap', 'dn')} SELECT doc_id, section_ord, section, length(text) AS n_chars FROM secs WHERE section NOT IN ('Full_text', 'References')"
SQL["references_normalize"] = rf"""WITH {_REFS}, g AS (SELECT doc_id, string_agg(ref_full_text, E'\n\n' ORDER BY ref_ord) AS t FROM prefs GROUP BY 1),
a AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(\d+)\.\s*\n\n+\s*([A-Z][a-zÀ-ÿ])', '\1. \2', 'g'), '(\[\d+\])\s*\n\n+\s*([A-Z][a-zÀ-ÿ])', '\1 \2', 'g') AS t FROM g),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([.;])\s+(\d+\.\s+[A-Z][a-z])', E'\\1\n\n\\2', 'g'), '([.;])\s+(\[\d+\]\s*[A-Z])', E'\\1\n\n\\2', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(\.)\s+([A-Z][a-zÀ-ÿ]+(?:[-''][A-Z][a-z]+)?,\s+[A-Z]\.)', E'\\1\n\n\\2', 'g'), '(\.) +([A-Z][a-zÀ-ÿ]+(?:[-''][A-Z][a-z]+)?,\s+[A-Z]\.)', E'\\1\n\n\\2', 'g') AS t FROM b),
l AS (SELECT doc_id, unnest(regexp_split_to_array(t, '\n\n+')) AS b, unnest(range(len(regexp_split_to_array(t, '\n\n+')))) AS i FROM c), n AS (SELECT doc_id, i, trim(regexp_replace(b, '\s+', ' ', 'g')) AS b FROM l),
s AS (SELECT *, CASE WHEN regexp_matches(b, '^\[\d+\]|^\d+\.\s+[A-Z]') OR (regexp_matches(b, '^[A-Z][a-zÀ-ÿ]+(?:[-''][A-Z][a-z]+)?,\s+[A-Z]\.') AND (regexp_matches(b, '\d{{4}}') OR length(b) >= 40)) OR (regexp_matches(b, '^[A-Z]{{2,}}[,.]') AND length(b) >= 40) OR row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1 THEN 1 ELSE 0 END AS new FROM n WHERE length(b) > 0),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS ref_ord FROM s) SELECT doc_id, ref_ord, string_agg(b, ' ' ORDER BY i) AS ref_text FROM r GROUP BY 1, 2"""
_fence = lambda t: rf"replace(regexp_replace({t}, '(?s)```[a-zA-Z]*\n(.*?)```', '\1', 'g'), '```', '')"
_MARKED = r"regexp_replace(text, '(?m)^==+[ \t\n\r\f]*(.*?)[ \t\n\r\f]*==+[ \t\n\r\f]*$', '## \1', 'g')"
SQL["markdown_sections"] = rf"""WITH d AS (SELECT doc_id, string_split({_fence(_MARKED)}, E'\n') AS ls FROM documents WHERE length(text) > 0),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d), h AS (SELECT *, regexp_matches(line, '^##\s+[A-Z0-9]') OR (regexp_matches(line, '^#\s+[A-Z]') AND coalesce(length(trim(lag(line) OVER w)) = 0, true)) AS head FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM h),
p AS (SELECT doc_id, g, coalesce(max(CASE WHEN head THEN trim(regexp_replace(line, '^#+', '')) END), 'Preamble') AS section, regexp_replace(coalesce(string_agg(line, E'\n' ORDER BY i) FILTER (NOT head), ''), '^\s+|\s+$', '', 'g') AS text FROM g GROUP BY 1, 2)
SELECT doc_id, section, length(arg_max(text, g)) AS n_chars FROM p WHERE g > 0 OR length(text) > 10 GROUP BY 1, 2"""
_STATE = "struct_pack(line := {}, mode := {}, blanks := {}, kept := {})"


def _folded(source: str, step: str) -> str:
    """doc_id, text: a fold over the lines of ``source`` (doc_id, t)."""
    first = _STATE.format("''", "0", "0", "CAST('' AS VARCHAR)")
    one = _STATE.format("l", "0", "0", "CAST('' AS VARCHAR)")
    return f"SELECT doc_id, substring(list_reduce(list_prepend({first}, list_transform(string_split(t, E'\\n'), lambda l: {one})), lambda a, x: {step}).kept, 2) AS text FROM {source}"


_keep = "a.kept || E'\\n' || x.line"
_trow = lambda m, b, k: _STATE.format("''", m, b, k)
SQL["table_removal"] = "WITH src AS (SELECT doc_id, text AS t FROM documents WHERE length(text) > 0) " + _folded("src", rf"""CASE WHEN regexp_matches(x.line, '(?i)^\s*(\*\*)?Table\s+\d+') OR contains(x.line, '|') OR regexp_matches(x.line, '^\s*[-|:]+\s*$') THEN {_trow('1', '0', 'a.kept')}
 WHEN a.mode = 1 AND length(trim(x.line)) = 0 THEN {_trow('CASE WHEN a.blanks >= 1 THEN 0 ELSE 1 END', 'CASE WHEN a.blanks >= 1 THEN 0 ELSE a.blanks + 1 END', 'a.kept')} WHEN a.mode = 1 AND regexp_matches(x.line, '\s{{3,}}|-{{3,}}') THEN {_trow('1', '0', 'a.kept')} ELSE {_trow('0', '0', _keep)} END""")
SQL["figure_caption_removal"] = r"WITH src AS (SELECT doc_id, regexp_replace(text, '(?m)^\* ', 'Figure 1: ', 'g') AS t FROM documents WHERE length(text) > 0) " + _folded("src", rf"""CASE WHEN regexp_matches(x.line, '(?i)^\s*(\*\*)?(Fig\.|Figure)\s+\d+[:.\s]') THEN {_trow("CASE WHEN regexp_matches(x.line, '[.!][ \t\r\f]*$') OR length(trim(x.line)) < 100 THEN 0 ELSE 1 END", '0', 'a.kept')}
 WHEN a.mode = 1 THEN {_trow("CASE WHEN regexp_matches(x.line, '[.!][ \t\r\f]*$') OR length(trim(x.line)) = 0 THEN 0 ELSE 1 END", '0', 'a.kept')} ELSE {_trow('0', '0', _keep)} END""")


def _chain(x: str, *pairs: tuple[str, str]) -> str:
    for p, to in pairs:
        x = f"regexp_replace({x}, '{p}', {to}, 'g')"
    return x


_noun, _num = "|".join(se.COUNTED), r"\d{1,3}(?:\s*[,\-]\s*\d{1,3})*"
_MASK = (rf"(?i)(^|[^\p{{L}}])({_noun})\s+(\d+(?:\s*[,;\-]\s*\d+)*)", "'\\1\\2' || chr(1) || '\\3' || chr(2)")
_GLUED = (rf"(?i)(^|[^\p{{L}}])({_noun})(\d{{1,3}})([^\d]|$)", "'\\1\\2' || chr(3) || '\\3\\4'")
_COMMA = (r"(\d)\s*,\s*(\d[^\[\]]*\])", "'\\1,\\2'")
_supers = _chain(
    _chain("translate(regexp_replace(text, '([¹²³⁴⁵⁶⁷⁸⁹⁰]+)', '[\\1]', 'g'), '¹²³⁴⁵⁶⁷⁸⁹⁰', '1234567890')", (r"([.!?])\s+(\d{1,3})\s+([A-Z])", "'\\1[\\2] \\3'"), _MASK),
    (rf"([a-z)])\s+({_num})(\s|[.,;!?]|$)", "'\\1[\\2]\\3'"), (r"([a-z])\s+(\d{1,3}e\d{1,3})(\s|[.,;!?]|$)", "'\\1[\\2]\\3'"), (r"(\n)(\d{1,3})\s+([A-Z])", "'\\1[\\2] \\3'"),
    (r"\[\s+", "'['"), (r"\s+\]", "']'"), *[_COMMA] * 6, (r"\[(\d+)e(\d+)\]", "'[\\1-\\2]'"), _GLUED, _GLUED, (r"([a-z]{3,})(\d{1,3})(\s|[.,;!?]|$)", "'\\1[\\2]\\3'"),
)
SQL["superscript_convert"] = f"SELECT DISTINCT sentence_id, translate(replace({_supers}, chr(1), ' '), chr(2) || chr(3), '') AS text FROM sentences WHERE length(text) > 0"
_HEADERS = r"""hp AS (SELECT doc_id, regexp_replace(text, '\. ', E'\n12\n\nAnnals of Applied Acoustics, the second volume of it\n', 'g') AS text FROM papers), hs AS (SELECT doc_id, unnest(list_transform(regexp_split_to_array(text, '\d+\n\n')[2:], lambda x: substring(x, 1, 200))) AS tail FROM hp),
 hg AS (SELECT doc_id, substring(tail, 1, 40) AS key, count(*) AS n, min(tail) AS a, max(tail) AS b FROM hs GROUP BY 1, 2 HAVING count(*) >= 3 AND length(substring(any_value(tail), 1, 40)) = 40),
 heads AS (SELECT doc_id, trim(substring(a, 1, coalesce(list_min(list_filter(range(1, 201), lambda k: k > length(a) OR substring(a, k, 1) <> substring(b, k, 1))) - 1, 200))) AS header, n FROM hg)"""
SQL["running_headers"] = f"WITH {PAPERS}, {_HEADERS} SELECT * FROM heads"
SQL["headers_removed"] = f"WITH {PAPERS}, {_HEADERS}, one AS (SELECT doc_id, list(DISTINCT header) AS h FROM heads GROUP BY 1) SELECT hp.doc_id, CASE WHEN h IS NULL THEN text WHEN len(h) = 1 THEN replace(text, h[1], '') ELSE replace(replace(text, list_sort(h)[1], ''), list_sort(h)[2], '') END AS text FROM hp LEFT JOIN one ON hp.doc_id = one.doc_id"
_spaced = r"array_to_string(list_transform(string_split(t, E'\n'), lambda l: CASE WHEN regexp_matches(l, '^\s*(?:[A-Z]{1,4} ){3,}[A-Z]{1,4}\s*$') AND len(list_filter(string_split(trim(l), ' '), lambda g: length(g) <= 2)) * 2 >= len(string_split(trim(l), ' ')) AND length(trim(l)) >= 7 THEN replace(l, ' ', '') ELSE l END), E'\n')"
SQL["spaced_headings"] = rf"WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?m)^==+.*$', 'R E S U L T S', 'g'), '\. ', '. 2 | METHODS of ', 'g') AS t FROM documents WHERE length(text) > 0) SELECT doc_id, regexp_replace({_spaced}, '(\.)\s+([0-9]+(?:\.[0-9]+)*\s*\|\s*[A-Z])', E'\\1\n\n\\2', 'g') AS text FROM s"
SQL["plain_ligatures"] = "SELECT DISTINCT sentence_id, replace(replace(replace(replace(replace(replace(replace(text, 'fi', 'ﬁ'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), chr(160), ' ') AS text FROM sentences WHERE length(text) > 0"
SQL["code_fences"] = rf"""SELECT doc_id, {_fence("regexp_replace(text, '(?m)^==+.*$', E'```python\\nx = 1\\n```', 'g')")} AS text FROM documents WHERE length(text) > 0"""
_LONE = (r"(^|[^.!?\n])\n([^A-Z0-9\n]|$)", "'\\1 \\2'")
_ai = _chain("regexp_replace(regexp_replace(text, '(?m)^==+[ \\t\\n\\r\\f]*(.*?)[ \\t\\n\\r\\f]*==+[ \\t\\n\\r\\f]*$', '2.1. \\1', 'g'), ' of ', E' of\\n', 'g')", (r"([0-9]+(?:\.[0-9]+)*\.\s+[A-Za-z][A-Za-z\s]{3,50})", "E'\\n\\n\\\\1\\n\\n'"), (r"\n\s*\n", "E'\\n\\n'"), (r"([.!?])\s*\n\s*([A-Z][a-z])", "E'\\\\1\\n\\n\\\\2'"), _LONE, _LONE, (r"-\s", "''"))
SQL["ai_text"] = f"SELECT doc_id, {_ai} AS text FROM documents WHERE length(text) > 0"
_TOC_SRC = r"""td AS (SELECT doc_id, regexp_replace(text, '(?m)^==+[ \t\n\r\f]*([A-Za-z][A-Za-z ]*?)[ \t\n\r\f]*==+[ \t\n\r\f]*$', E'\n\n\\1\n', 'g') AS t, list_distinct(list_filter(regexp_extract_all(text, '(?m)^==+[ \t\n\r\f]*([A-Za-z][A-Za-z ]*?)[ \t\n\r\f]*==+[ \t\n\r\f]*$', 1), lambda h: length(h) <= 80)) AS toc FROM documents WHERE length(text) > 0),
 tn AS (SELECT doc_id, unnest(range(len(toc))) AS i, unnest(toc) AS name FROM td), tf AS (SELECT DISTINCT n.doc_id FROM tn n JOIN td d ON n.doc_id = d.doc_id WHERE regexp_matches(t, '(?i)\n\s*(?:[0-9]+(?:\.[0-9]+)*\.?\s*\|?\s+)?' || name || '[\s.:]')),"""
SQL["section_split_toc"] = f"WITH {_TOC_SRC} dn AS (SELECT * FROM tn WHERE doc_id IN (SELECT doc_id FROM tf) UNION ALL SELECT doc_id, unnest(range({len(se.SECTION_NAMES)})), unnest([{', '.join(map(_q, se.SECTION_NAMES))}]) FROM td WHERE doc_id NOT IN (SELECT doc_id FROM tf)), {_sections('td', 'dn')} SELECT doc_id, section_ord, section, length(text) AS n_chars FROM secs"

# Moves ----------------------------------------------------------------------------------


def _sentences(source: str) -> str:
    """CTE ``segs`` from ``source`` (doc_id, section_ord, section, text)."""
    t = "regexp_replace(regexp_replace(text, '(?m)^#+[ \\t\\n\\r\\f].*$', '', 'g'), '\\s+', ' ', 'g')"
    for a in moves.ABBREVIATIONS:
        t = f"regexp_replace({t}, '(^|[^\\p{{L}}]){a.replace('.', '[.]')}\\.', '\\1{a.replace('.', '§')}§', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '(\\d)\\.(\\d)', '\\1§\\2', 'g'), '(\\d)\\.(\\d)', '\\1§\\2', 'g')"
    return rf"""sg0 AS (SELECT doc_id, section_ord, section, string_split(regexp_replace({t}, '([.!?])\s+([A-Z"“''(])', '\1¶\2', 'g'), '¶') AS ps FROM {source} WHERE length(trim(text)) >= 10),
 sg1 AS (SELECT doc_id, section_ord, section, unnest(range(len(ps))) AS i, trim(replace(unnest(ps), '§', '.')) AS text FROM sg0),
 segs AS (SELECT doc_id, section_ord, section, row_number() OVER (PARTITION BY doc_id ORDER BY section_ord, i) AS sentence_id, text, CASE WHEN count(*) OVER (PARTITION BY doc_id, section_ord) = 1 THEN 50.0 ELSE round((row_number() OVER (PARTITION BY doc_id, section_ord ORDER BY i) - 1) / (count(*) OVER (PARTITION BY doc_id, section_ord) - 1) * 100, 1) END AS position_pct FROM sg1 WHERE length(text) >= 15)"""


SQL["sentence_segments"] = f"WITH {SECTIONS}, {_sentences('sections')} SELECT * FROM segs"
_PIPE = _move_rules().replace("SELECT DISTINCT sentence_id, coalesce(section, '') AS section, text, position_pct AS p FROM sentences WHERE length(text) > 0", "SELECT doc_id * 1000000 + sentence_id AS sentence_id, section, text, position_pct AS p FROM segs")
SQL["move_pipeline"] = rf"""WITH {SECTIONS}, wanted AS (SELECT * FROM sections WHERE NOT regexp_matches(section, '(?i)(results|findings|references|appendix|acknowledg|bibliography|full_text|preface|preamble|method|material|experimental|procedure)')), {_sentences('wanted')}, {_PIPE}
SELECT doc_id, s.sentence_id, s.section, s.position_pct, coalesce(b.m, 'Unclassified') AS move, b.t AS step, coalesce(round(b.c, 3), 0.0) AS confidence, CASE WHEN b.m IS NULL THEN 'none' ELSE 'rule' END AS method FROM segs s JOIN base ON base.sentence_id = doc_id * 1000000 + s.sentence_id AND tax IS NOT NULL LEFT JOIN best ON best.sentence_id = base.sentence_id"""
_TAX = """CASE WHEN regexp_matches(s, 'introduction|\\bintro\\b') THEN 'introduction' WHEN regexp_matches(s, 'literature|related work|background|state of the art|theoretical framework|review') THEN 'literature_review' WHEN regexp_matches(s, 'discussion|conclusion|implication|closing remarks') THEN 'discussion' WHEN regexp_matches(s, 'method|material|experimental|procedure|design|data collection') THEN NULL ELSE 'introduction' END"""
_BATCH = f"""bt AS (SELECT sentence_id, s.*, {_TAX.replace("(s,", "(lower(coalesce(s.section, '')),")} AS taxonomy_type FROM (SELECT sentence_id, min(struct_pack(paper_id := paper_id, section := section, text := text, move := move, step := step, confidence := confidence)) AS s FROM sentences WHERE length(text) > 0 GROUP BY 1)),
 bk AS (SELECT *, row_number() OVER (PARTITION BY paper_id, taxonomy_type ORDER BY sentence_id) AS k FROM bt WHERE taxonomy_type IS NOT NULL), ba AS (SELECT *, CAST(ceil(k / 20) AS INT) AS batch, CAST((k - 1) % 20 + 1 AS INT) AS id FROM bk)"""


def _told(tax: str) -> str:
    lines: list[str] = []
    for t, move, label, step, *_ in moves.LEXICON:
        if t == tax:
            lines += [x for x in (f"{move}: {label}",) if x not in lines] + [f"  - {step}"]
    return _q("\n".join(lines))


_KINDS = list(dict.fromkeys(x[0] for x in moves.LEXICON))
SQL["move_prompts"] = f"WITH {_BATCH} SELECT paper_id, taxonomy_type, batch, count(*) AS n_sentences, {_q(moves.PROMPT_HEAD)} || CASE taxonomy_type " + " ".join(f"WHEN '{t}' THEN {_told(t)}" for t in _KINDS) + f" END || E'\\n\\n' || string_agg(id || '. ' || text, E'\\n' ORDER BY id) || {_q(moves.PROMPT_TAIL)} AS prompt FROM ba GROUP BY 1, 2, 3"
_labels = " ".join(f"WHEN taxonomy_type = '{t}' AND code = '{m}' THEN {_q(label)}" for (t, m), label in {(x[0], x[1]): x[2] for x in moves.LEXICON}.items())
SQL["move_answers"] = rf"WITH {_BATCH}, c AS (SELECT *, regexp_extract(move, '^(M\d)', 1) AS code FROM ba) SELECT sentence_id, batch, id, CASE WHEN move IS NOT NULL THEN code || ': ' || CASE {_labels} ELSE code END END AS move_llm, CASE WHEN move IS NOT NULL THEN step END AS step_llm, CASE WHEN move IS NOT NULL THEN least(greatest(coalesce(confidence * 2, 0.0), 0.0), 1.0) ELSE 0.0 END AS conf_llm FROM c"
SQL["csv_export"] = SQL["move_distribution"]

# Pages ----------------------------------------------------------------------------------
_VALID = f"""{_GUT}, side AS (SELECT b.doc_id, b.page, b.y, b.x < g.threshold AS l FROM boxes b JOIN gut g ON b.doc_id = g.doc_id AND b.page = g.page),
 va AS (SELECT doc_id, page, count(*) FILTER (l) AS nl, count(*) FILTER (NOT l) AS nr, min(y) FILTER (l) AS l0, max(y) FILTER (l) AS l1, min(y) FILTER (NOT l) AS r0, max(y) FILTER (NOT l) AS r1, count(DISTINCT round_even(y / 4, 0)) FILTER (l) AS ll, count(DISTINCT round_even(y / 4, 0)) FILTER (NOT l) AS lr FROM side GROUP BY 1, 2),
 valid AS (SELECT doc_id, page, coalesce(nl >= 5 AND nr >= 5 AND (least(l1, r1) - greatest(l0, r0)) / nullif(greatest(l1, r1) - least(l0, r0), 0) >= 0.3 AND ll >= 3 AND lr >= 3, false) AS two_columns FROM va),
 gl AS (SELECT g.doc_id, quantile_cont(threshold, 0.5) AS threshold, count(*) AS n_pages FROM gut g JOIN valid v ON g.doc_id = v.doc_id AND g.page = v.page WHERE two_columns AND n >= 30 AND greatest(n_left, n - n_left) <= 3 * least(n_left, n - n_left) GROUP BY 1)"""
SQL["page_columns"] = f"WITH {_VALID} SELECT * FROM valid"
SQL["global_gutter"] = f"WITH {_VALID} SELECT doc_id, round(threshold, 4) AS threshold, n_pages FROM gl"
_TITLE_LINE = r"(length({0}) < 80 AND ((regexp_matches({0}, '^[A-Z0-9 ,:;&()/\-]+$') AND regexp_matches({0}, '[A-Z]')) OR regexp_matches({0}, '^\d+\.\s') OR regexp_matches({0}, '^\d+\.\d+')))"
_PAGES = rf"""{_VALID}, cb AS (SELECT b.*, CASE WHEN threshold IS NULL OR x < threshold THEN 1 ELSE 2 END AS col FROM boxes b LEFT JOIN gl ON b.doc_id = gl.doc_id),
 cy AS (SELECT DISTINCT doc_id, page, col, y FROM cb), cg AS (SELECT doc_id, page, col, y - lag(y) OVER (PARTITION BY doc_id, page, col ORDER BY y) AS gap FROM cy), cm AS (SELECT doc_id, page, col, quantile_cont(gap, 0.5) AS mid FROM cg WHERE gap IS NOT NULL GROUP BY 1, 2, 3),
 cs AS (SELECT g.doc_id, g.page, g.col, quantile_cont(gap, 0.5) AS m FROM cg g JOIN cm ON g.doc_id = cm.doc_id AND g.page = cm.page AND g.col = cm.col WHERE gap <= mid GROUP BY 1, 2, 3), cn AS (SELECT doc_id, page, col, count(*) AS n FROM cb GROUP BY 1, 2, 3),
 ct AS (SELECT cn.doc_id, cn.page, cn.col, CASE WHEN n < 10 THEN 4.0 ELSE coalesce(least(greatest(ceil(m * 1.5), 2), 8), 4.0) END AS tol FROM cn LEFT JOIN cs ON cn.doc_id = cs.doc_id AND cn.page = cs.page AND cn.col = cs.col),
 cl AS (SELECT b.doc_id, b.page, b.col, round_even(y / tol, 0) * tol AS line_y, string_agg(text, ' ' ORDER BY x, word_ord) AS line FROM cb b JOIN ct ON b.doc_id = ct.doc_id AND b.page = ct.page AND b.col = ct.col GROUP BY 1, 2, 3, 4),
 cp AS (SELECT *, lag(line) OVER w AS before FROM cl WINDOW w AS (PARTITION BY doc_id, page, col ORDER BY line_y)),
 ptext AS (SELECT doc_id, page, col, string_agg(CASE WHEN before IS NULL THEN '' WHEN {_TITLE_LINE.format('line')} OR {_TITLE_LINE.format('before')} OR regexp_matches(line, '^\[\d+\]') THEN E'\n\n' ELSE ' ' END || line, '' ORDER BY line_y) AS text FROM cp GROUP BY 1, 2, 3)"""
SQL["page_text"] = f'WITH {_PAGES} SELECT doc_id, page, col AS "column", text FROM ptext'
_laid = _chain("t", (r"([0-9]+(?:\.[0-9]+)*\.\s+[A-Z][A-Za-z\s]{3,50})", "E'\\n\\n\\\\1'"), (r"\s+([A-Z][A-Z\s]{10,60})\s+", "E'\\n\\n\\\\1\\n\\n'"), (r"([.!?])\s+([A-Z][a-z])", "E'\\\\1\\n\\n\\\\2'"), (r"\n{3,}", "E'\\n\\n'"), (r"-\s*\n", "''"), (r"-\s+", "''"), (r"[ \t]+", "' '"), (r"\n ", "E'\\n'"), (r"^\s+|\s+$", "''"))
SQL["document_text"] = f"""WITH {_PAGES}, jp AS (SELECT doc_id, string_agg(text, E'\\n\\n' ORDER BY page, col) AS t FROM ptext GROUP BY 1), la AS (SELECT doc_id, {_laid} AS laid FROM jp), d AS (SELECT doc_id, text FROM documents WHERE length(text) > 0)
SELECT coalesce(d.doc_id, la.doc_id) AS doc_id, CASE WHEN coalesce(length(laid), 0) < 100 THEN coalesce(d.text, laid) ELSE laid END AS text FROM d FULL JOIN la ON d.doc_id = la.doc_id"""
SQL["column_assign"] = f"""WITH {BOXES}, e AS (SELECT doc_id, page, min(x) AS lo, max(x) AS hi FROM boxes GROUP BY 1, 2) SELECT b.doc_id, b.page, CAST(x > lo + (hi - lo) / 3 * 1 AS INT) + CAST(x > lo + (hi - lo) / 3 * 2 AS INT) + 1 AS "column", count(*) AS n_words FROM boxes b JOIN e ON b.doc_id = e.doc_id AND b.page = e.page GROUP BY 1, 2, 3"""
_HEAD = f"{BOXES}, {HEADED}"
SQL["page_titles"] = f"WITH {_HEAD} SELECT doc_id, page, line_y, {_TITLE_LINE.format('line')} AS title FROM headed"
_TOPS = f"{_HEAD}, tops AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_y) AS k FROM headed), sig AS (SELECT doc_id, substring(line, 1, 40) AS signature, count(*) AS n_pages FROM tops WHERE k = 1 GROUP BY 1, 2 HAVING count(*) >= 3)"
SQL["page_headers"] = f"WITH {_TOPS} SELECT * FROM sig"
SQL["page_headers_removed"] = f"WITH {_TOPS} SELECT t.doc_id, page, count(*) AS n_lines FROM tops t LEFT JOIN sig ON t.doc_id = sig.doc_id AND k = 1 AND substring(line, 1, 40) = signature WHERE sig.doc_id IS NULL GROUP BY 1, 2"
SQL["first_page_header"] = rf"""WITH {_HEAD}, f AS (SELECT doc_id, bool_or(page = 1 AND regexp_matches(line, '(?i)journal|issn|doi|volume|received|accepted|elsevier|springer|wiley')) AS m, min(CASE WHEN page = 1 AND regexp_matches(line, '(?i)^\s*(?:\d+\.?\s*)?introduction\b') THEN line_y END) AS i FROM headed GROUP BY 1)
SELECT h.doc_id, page, count(*) AS n_lines FROM headed h JOIN f ON h.doc_id = f.doc_id WHERE NOT (page = 1 AND m AND i IS NOT NULL AND line_y < i) GROUP BY 1, 2"""
SQL["first_page_footer"] = rf"""WITH {_HEAD}, q AS (SELECT *, min(line_y) OVER w + (max(line_y) OVER w - min(line_y) OVER w) * 0.75 AS q FROM headed WINDOW w AS (PARTITION BY doc_id, page)),
f AS (SELECT *, min(CASE WHEN page = 1 AND line_y >= q AND regexp_matches(line, '(?i)correspond|e-?mail|received|copyright|©|https?://|doi\.org|published by|all rights') THEN line_y END) OVER (PARTITION BY doc_id, page) AS f FROM q)
SELECT doc_id, page, count(*) AS n_lines FROM f WHERE NOT (page = 1 AND f IS NOT NULL AND line_y >= f) GROUP BY 1, 2"""
SQL["interleaved_pages"] = r"""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]\s+')) AS s FROM documents WHERE length(text) > 0), k AS (SELECT * FROM s WHERE length(s) > 20), m AS (SELECT doc_id, quantile_cont(length(s), 0.5) AS mid, count(*) AS n FROM k GROUP BY 1)
SELECT k.doc_id, any_value(n) >= 10 AND (avg(CASE WHEN length(s) < 0.3 * mid THEN 1 ELSE 0 END) > 0.4 OR avg(CASE WHEN regexp_matches(s, '^[a-z]') THEN 1 ELSE 0 END) > 0.3) AS interleaved FROM k JOIN m ON k.doc_id = m.doc_id GROUP BY 1"""
SQL["page_chunks"] = f"WITH {BOXES}, p AS (SELECT DISTINCT doc_id, page FROM boxes) SELECT doc_id, CAST(ceil(page / 4) AS INT) AS chunk, min(page) AS first_page, count(*) AS n_pages FROM p GROUP BY 1, 2"

# Messages and document information -------------------------------------------------------
SQL["index_references"] = """SELECT r.paper_id AS doc_id, CAST(row_number() OVER (PARTITION BY r.paper_id ORDER BY ref_row_id) AS INT) AS ref_ord, r.ref_key, r.doi, r.article_title, r.ref_year, r.journal, r.volume, r.first_page, r.ref_full FROM
 (SELECT ref_row_id, min(struct_pack(paper_id := paper_id, ref_key := ref_key, doi := doi, article_title := article_title, ref_year := ref_year, journal := journal, volume := volume, first_page := first_page, ref_full := ref_full)) AS r FROM crossref_refs GROUP BY 1)"""
_ent = "translate('“Smart” &amp; ‘plain’… &lt;b&gt; ' || text, '‘’“”–—…', chr(39) || chr(39) || '\"\"--.')"
for _a, _b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", chr(39) * 2), ("&nbsp;", " ")):
    _ent = f"replace({_ent}, '{_a}', '{_b}')"
SQL["clean_encoding"] = rf"SELECT DISTINCT sentence_id, trim(regexp_replace(regexp_replace({_ent}, '[\x00-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM sentences WHERE length(text) > 0"
_PACKETS = "pk AS (SELECT paper_id AS doc_id, arg_max(struct_pack(doi := translate(coalesce(doi, ''), '<>', ''), title := translate(coalesce(title, ''), '<>', ''), journal := translate(coalesce(journal_title, ''), '<>', ''), y := coalesce(CAST(publication_year AS VARCHAR), '')), struct_pack(a := fetched_at, b := doi, c := title, d := journal_title, e := publication_year)) AS m FROM main_metadata GROUP BY 1)"
_own = r"regexp_extract(m.doi, '10\.\d{4,9}/[-._;()/:A-Za-z0-9]+')"
SQL["document_dois"] = f"WITH {_PACKETS} SELECT doc_id, concat_ws(' ', nullif({_own}, ''), '10.5555/again.1') AS dois FROM pk"
SQL["document_packets"] = rf"WITH {_PACKETS} SELECT doc_id, nullif(trim(m.title), '') AS title, 'A. One; B. Two' AS authors, nullif(trim(m.journal), '') AS journal, nullif(regexp_extract(m.y || '-01', '^(\d{{4}})', 1), '') AS year, coalesce(nullif({_own}, ''), '10.5555/again.1') AS doi FROM pk"
