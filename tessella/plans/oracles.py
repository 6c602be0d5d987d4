"""DuckDB SQL of the core queries, written apart from the plans; word lists and the fold map are shared."""

from __future__ import annotations

from ..functions import lexicon
from ..functions.text import fold_map
from ..functions.text import folded as py_folded

_A, _B = fold_map()
_BL = r"[\s\p{Z}]"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def strip(x):
    return f"regexp_replace({x}, '^{_BL}+|{_BL}+$', '', 'g')"


def clean(x):
    return strip(rf"regexp_replace(regexp_replace(replace({x}, chr(0), ' '), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def dehyphen(x):
    """Twice, as a letter may close one break and open the next."""
    once = rf"regexp_replace(replace({x}, chr(0), ' '), '([\p{{L}}\p{{N}}_])-{_BL}*\n{_BL}*([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    return clean(rf"regexp_replace({once}, '([\p{{L}}\p{{N}}_])-{_BL}*\n{_BL}*([\p{{L}}\p{{N}}_])', '\1\2', 'g')")


def repair(x):
    """Words stand between markers, so that the bounds of words are characters."""
    x = rf"regexp_replace(translate({dehyphen(x)}, 'Ðð', 'Đđ'), '([\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(2), 'g')"
    gap, one = rf"\x02{_BL}+\x01", f"([{lexicon.CAPITALS}])"
    x = rf"regexp_replace({x}, '\x01{one}{gap}{one}{gap}{one}\x02', chr(1) || '\1\2\3' || chr(2), 'g')"
    for pattern, right in lexicon.OCR_REWRITES:
        body = pattern[2:-2].replace(r",\s*", rf"\x02,{_BL}*\x01").replace(r"\s+", gap)
        words = " ".join(rf"chr(1) || '{w.rstrip(',')}' || chr(2){" || ','" if w.endswith(',') else ''} || ' ' ||" for w in right.split())
        x = rf"regexp_replace({x}, '(?i)\x01{body}\x02', {words.removesuffix("|| ' ' ||")}, 'g')"
    x = f"replace(replace({x}, chr(1), ''), chr(2), '')"
    x = rf"regexp_replace({x}, '{_BL}+([,.;:!?])', '\1', 'g')"
    x = rf"regexp_replace({x}, '([(\[{{]){_BL}+', '\1', 'g')"
    return dehyphen(rf"regexp_replace({x}, '{_BL}+([)\]}}])', '\1', 'g')")


def low(x):
    return fold(f"lower({x})")


def whole(x, pattern):
    """Does a pattern of words stand in the text, bounds at its ends?"""
    return f"regexp_matches({x}, {_q(r'(?i)(^|[^\p{L}\p{N}_])' + pattern + r'([^\p{L}\p{N}_]|$)')})"


def ref_list(x):
    found = rf"regexp_extract_all(upper({fold(x)}), {_q(lexicon.LEGAL_NUMBER)}, 1)"
    return rf"list_transform({found}, lambda r: replace(replace(regexp_replace(r, '\s+', '', 'g'), 'ND-', 'NĐ-'), 'QD-', 'QĐ-'))"


def runs(w, n):
    return f"list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))"


def quality(x):
    body = f"regexp_replace({x}, '[\\s\\p{{Z}}]+', '', 'g')".replace("\\\\", "\\")
    alpha = rf"length(regexp_replace({body}, '[^\p{{L}}]+', '', 'g')) / greatest(length({body}), 1)"
    good = rf"len(list_filter({raw_words(x)}, lambda w: length(w) >= 3 AND length(regexp_replace(w, '[^\p{{L}}]+', '', 'g')) >= length(w) * 0.8)) / greatest(len({raw_words(x)}), 1)"
    return f"floor(greatest(0.0, least(1.0, 0.55 * ({alpha}) + 0.45 * least(1.0, ({good}) / 0.62))) * 1000 + 0.5) / 1000"


def doc_types(x):
    out = ""
    for name, pattern in lexicon.TYPES.items():
        parts = [whole(x, a[2:-2]) if a.startswith(r"\b") else f"regexp_matches({x}, {_q('(?i)' + a)})" for a in _alternatives(pattern)]
        out += f" WHEN {' OR '.join(parts)} THEN '{name}'"
    return f"CASE{out} ELSE 'OtherLegalDocument' END"


def _alternatives(pattern):
    head, _, tail = pattern.partition(r"\b|")
    return [head + r"\b", tail] if tail else [pattern]


def dates(x):
    d = r"(?i)ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
    part = lambda i: f"CAST(regexp_extract(s, '{d}', {i}) AS INT)"
    made = f"list_transform(regexp_extract_all(substring({x}, 1, 5000), '{d}', 0), lambda s: TRY_CAST(format('{{:04d}}-{{:02d}}-{{:02d}}', {part(3)}, {part(2)}, {part(1)}) AS DATE))"
    return f"list_filter({made}, lambda v: v IS NOT NULL)[1]"


def fold(x):
    return rf"regexp_replace(translate({x}, {_q(_A)}, {_q(_B)}), '\p{{Mn}}+', '', 'g')"


def words(x):
    return f"list_filter(regexp_split_to_array({strip(x)}, '{_BL}+'), lambda w: w <> '')"


def raw_words(x):
    return rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+')"


def tokens(x):
    return f"list_filter({raw_words(f'lower({x})')}, lambda t: length(t) > 1)"


def folded(x):
    """Folded as one text: tokens hold no blanks."""
    t = fold(f"array_to_string({tokens(x)}, ' ')")
    return f"list_filter(string_split({t}, ' '), lambda t: t <> '')"


def dual(x):
    return f"flatten(list_transform(list_zip({tokens(x)}, {folded(x)}), lambda p: CASE WHEN p[1] <> p[2] THEN [p[1], p[2]] ELSE [p[1]] END))"


def normalized(x):
    return f"array_to_string({raw_words(fold(f'lower({x})'))}, ' ')"


def sentences(x, marks=".!?。！？;:"):
    return rf"list_filter(list_transform(regexp_split_to_array(regexp_replace({x}, '([{marks}]){_BL}+', '\1' || chr(1), 'g'), '\x01|\n+'), lambda s: {clean('s')}), lambda s: s <> '')"


DOCS = "docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"
PASSAGES = f"""pw AS (SELECT doc_id, {words('t')} AS w FROM (SELECT doc_id, {clean('text')} AS t FROM documents) WHERE length(t) >= 40),
    pi AS (SELECT doc_id, w, unnest(range(0, 1 + CAST(ceil(greatest(len(w) - 450, 0) / 370.0) AS BIGINT))) AS i FROM pw),
    passages AS (SELECT doc_id, i + 1 AS chunk_on_page, doc_id * 1048576 + i AS chunk_id, array_to_string(w[i * 370 + 1 : i * 370 + 450], ' ') AS text FROM pi)"""
QUESTIONS = "questions AS (SELECT concept_no AS query_id, concept_label AS question FROM banking_ontology)"


def bm25(analyser, chunks="passages", df="count(*)"):
    return f"""tk AS (SELECT chunk_id, t FROM (SELECT chunk_id, {analyser('text')} AS t FROM {chunks}) WHERE len(t) > 0),
    st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM tk),
    qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({analyser('question')}) AS term FROM questions) GROUP BY ALL),
    po AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM tk) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
    df AS (SELECT term, {df} AS df FROM po GROUP BY term),
    scores AS (SELECT query_id, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 6) AS score
        FROM po JOIN df USING (term) JOIN qt USING (term), st GROUP BY query_id, chunk_id)"""


def top(source, k, columns, tie="chunk_id"):
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {tie}) AS rank FROM {source}) WHERE rank <= {k}"


RANKED = f"""{PASSAGES}, {QUESTIONS}, {bm25(tokens)},
    tops AS ({top('scores', 5, 'query_id, chunk_id, rank')}),
    ranked AS (SELECT query_id, question, rank, chunk_id, doc_id, chunk_on_page, text FROM tops JOIN passages USING (chunk_id) JOIN questions USING (query_id))"""
ALIASES = f"""al AS (SELECT DISTINCT id AS concept, {normalized('a')} AS alias FROM (SELECT id, concept_label AS a FROM banking_ontology UNION ALL SELECT id, unnest(aliases) AS a FROM banking_ontology) WHERE a IS NOT NULL)"""
MEMBERS = "members AS (SELECT subject_id AS unit, object_id AS key, count(*) AS n FROM facts WHERE object_id IS NOT NULL AND subject_id IS NOT NULL GROUP BY ALL)"
EDGES = f"""{MEMBERS}, mr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY n DESC, key) AS r FROM members) WHERE r <= 12),
    mk AS (SELECT unit, count(*) AS k FROM mr GROUP BY unit),
    edges AS (SELECT a.key AS source, b.key AS target, round(sum(1.0 / (k - 1)), 6) AS weight FROM mr a JOIN mr b ON a.unit = b.unit AND a.key < b.key JOIN mk ON mk.unit = a.unit GROUP BY ALL),
    bw AS (SELECT source AS u, target AS v, weight FROM edges UNION ALL SELECT target, source, weight FROM edges)"""


def _labels(rounds):
    out = "l0 AS (SELECT DISTINCT u, u AS label FROM bw)"
    for r in range(1, rounds + 1):
        out += f""", v{r} AS (SELECT bw.u, label, round(sum(weight), 6) AS w FROM bw JOIN l{r - 1} l ON l.u = bw.v GROUP BY bw.u, label),
        l{r} AS (SELECT u, label FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY w DESC, length(label), label) AS r FROM v{r}) WHERE r = 1)"""
    return out


def _intents():
    hit = lambda h: f"contains({normalized('question')}, {normalized(_q(h))})"
    return " UNION ALL ".join(f"SELECT query_id, '{p}' AS predicate FROM questions WHERE {' OR '.join(map(hit, hints))}" for p, hints in lexicon.INTENTS.items())


ASKED = """numbers AS (SELECT document_number, row_number() OVER (ORDER BY document_number) AS r FROM (SELECT DISTINCT document_number FROM doc_manifest WHERE document_number IS NOT NULL)),
    questions AS (SELECT concept_no AS query_id, concept_label AS question FROM banking_ontology UNION ALL
        SELECT 100000 + concept_no, 'Quyền của ' || concept_label || ' theo Điều ' || (concept_no % 60) || ' ' || document_number || ' là gì?' FROM banking_ontology JOIN numbers ON r = concept_no)"""
INDEX = "ix AS (SELECT DISTINCT ON (id) id AS chunk_id, document, page, chunk_on_page, article, text, quality_score FROM chunks WHERE text IS NOT NULL)"


def concepts_in(source, key, text):
    """Concepts of whole aliases, with the longest such alias."""
    return f"""SELECT {key}, concept, (list(alias ORDER BY length(alias) DESC, alias DESC))[1] AS alias FROM (SELECT {key}, ' ' || {normalized(text)} || ' ' AS t FROM {source}), al
        WHERE alias <> '' AND contains(t, ' ' || alias || ' ') GROUP BY {key}, concept"""


def words_of(name, source, key, text, *more):
    """A table of folded words ``tw`` and folded lower text ``tl`` of a column, worked out once."""
    return f"{name} AS MATERIALIZED (SELECT {', '.join([key, *more])}, {folded(text)} AS tw, {low(text)} AS tl FROM {source})"


def overlap(q, t):
    """Of two rows of :func:`words_of`, to six places."""
    return f"round({raw_overlap(q, t)}, 6)"


def raw_overlap(q, t):
    return f"""CASE WHEN len({q}.tw) = 0 OR len({t}.tw) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct({q}.tw), {t}.tw)) / greatest(len(list_distinct({q}.tw)), 1)
        + CASE WHEN contains({t}.tl, {q}.tl) THEN 0.35 ELSE 0.0 END END"""


def _variants():
    """The variants of every question: pos, name, weight, text."""
    extra, plain = [], []
    for trigger, more in lexicon.EXPANSIONS.items():
        for t, xs in ((trigger, more), (py_folded(trigger), [py_folded(x) for x in more])):
            hit = f"(contains(lower(question), {_q(t)}) OR contains(lower({fold('question')}), {_q(t)}))"
            extra.append(f"CASE WHEN {hit} THEN {_q(''.join(' ' + x for x in xs))} ELSE '' END")
            plain.append(f"CASE WHEN {hit} THEN {_q(''.join(' ' + py_folded(x) for x in xs))} ELSE '' END")
    return f"""ex AS (SELECT query_id, question, {fold('question')} AS bare, {' || '.join(extra)} AS extra, {' || '.join(plain)} AS plain FROM questions),
    va AS (SELECT query_id, 0 AS pos, 'original' AS variant, 1.0::DOUBLE AS weight, {clean('question')} AS question FROM ex
        UNION ALL SELECT query_id, 1, 'unaccented', 0.95, bare FROM ex WHERE bare <> question
        UNION ALL SELECT query_id, 2, 'expanded', 0.55, question || extra FROM ex WHERE extra <> ''
        UNION ALL SELECT query_id, 3, 'expanded_unaccented', 0.50, bare || plain FROM ex WHERE extra <> ''),
    variants AS (SELECT query_id, variant, weight, question FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(question) ORDER BY pos) AS r FROM va WHERE question <> '') WHERE r = 1)"""


def _features(source, key, text):
    s = f"regexp_replace({strip(low(text))}, '{_BL}+', ' ', 'g')"
    return f"""SELECT {key}, f, count(*) * CASE WHEN starts_with(f, 'c:') THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END AS tf FROM (
        SELECT {key}, unnest(list_concat(list_transform(t, lambda x: 'w:' || x), list_transform(range(1, len(t)), lambda i: 'b:' || t[i] || '_' || t[i + 1]),
            flatten(list_transform([3, 4, 5], lambda k: list_transform(list_filter(list_transform(range(1, length(s) - k + 2), lambda i: substring(s, i, k)), lambda x: NOT starts_with(x, ' ') AND NOT ends_with(x, ' ')), lambda x: 'c:' || x))))) AS f
        FROM (SELECT {key}, {dual(text)} AS t, {s} AS s FROM {source}) WHERE len(t) > 0) GROUP BY {key}, f"""


def _vectors(name, source, key):
    h = "('0x' || substr(md5(f), 1, 15))::BIGINT"
    return f"""{name}0 AS (SELECT {key}, h % 2048 AS idx, sum(CASE WHEN (h >> 59) % 2 = 1 THEN -1.0 ELSE 1.0 END * (1 + ln(tf)) * ln(1 + (n - df + 0.5) / (df + 0.5))) AS v
        FROM (SELECT {key}, {h} AS h, tf, coalesce(df, 0) AS df, n FROM {source} LEFT JOIN fd USING (f), fn) GROUP BY ALL),
    {name} AS (SELECT {key}, idx, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS val FROM {name}0 WHERE abs(v) > 1e-12)"""


def _frequencies():
    return f"{PASSAGES}, {QUESTIONS}, fc AS ({_features('passages', 'chunk_id', 'text')}), fd AS (SELECT f, count(*) AS df FROM fc GROUP BY f), fn AS (SELECT count(DISTINCT chunk_id) AS n FROM fc)"


def _bonus_columns():
    """Phrase and focus bonus of q.l, q.w (question) in t.l (text): folded lower text and folded words."""
    phrase = " + ".join(["CASE WHEN q.l <> '' AND contains(t.l, q.l) THEN 0.60 ELSE 0.0 END", *[f"len(list_filter({runs('q.w', n)}, lambda r: contains(t.l, r))) * {w}" for n, w in ((4, 0.08), (3, 0.05), (2, 0.02))]])
    focus = " + ".join(f"CASE WHEN contains(q.l, {_q(p)}) AND contains(t.l, {_q(p)}) THEN 2.0 ELSE 0.0 END" for p in lexicon.FOCUS)
    return f"round(least({phrase}, 0.45), 6)::DOUBLE AS phrase, ({focus})::DOUBLE AS focus"


def _hybrid():
    ready = lambda source, key, text: f"(SELECT {key}, {low(text)} AS l, {folded(text)} AS w FROM {source})"
    scored = bm25(dual).replace("FROM questions", "FROM vq")
    return f"""{_frequencies()}, {_variants()}, vq AS (SELECT query_id || '#' || variant AS query_id, query_id AS qid, weight, question FROM variants),
    vf AS ({_features('vq', 'query_id', 'question')}), {_vectors('cv', 'fc', 'chunk_id')}, {_vectors('qv', 'vf', 'query_id')},
    se AS (SELECT qv.query_id, chunk_id, round(sum(cv.val * qv.val), 6) AS score FROM cv JOIN qv USING (idx) GROUP BY ALL),
    {scored},
    kb AS (SELECT qid, chunk_id, max(score * weight) AS s FROM scores JOIN vq USING (query_id) GROUP BY ALL),
    sb AS (SELECT c.qid, c.chunk_id, greatest(0.0, max(coalesce(se.score, 0.0) * weight)) AS s FROM (SELECT query_id, qid, weight, chunk_id FROM vq, (SELECT DISTINCT chunk_id FROM fc)) c LEFT JOIN se ON se.query_id = c.query_id AND se.chunk_id = c.chunk_id GROUP BY ALL),
    km AS (SELECT qid, min(s) AS lo, max(s) AS hi FROM kb GROUP BY qid), sm AS (SELECT qid, min(s) AS lo, max(s) AS hi FROM sb GROUP BY qid),
    kn AS (SELECT qid, chunk_id, CASE WHEN hi = lo THEN 1.0 ELSE (s - lo) / (hi - lo) END AS keyword FROM kb JOIN km USING (qid)),
    sn AS (SELECT qid, chunk_id, CASE WHEN hi = lo THEN 1.0 ELSE (s - lo) / (hi - lo) END AS semantic FROM sb JOIN sm USING (qid)),
    bo AS (SELECT q.query_id AS qid, t.chunk_id, {_bonus_columns()} FROM {ready('questions', 'query_id', 'question')} q, {ready('passages', 'chunk_id', 'text')} t),
    fu AS (SELECT sn.qid AS query_id, sn.chunk_id, coalesce(keyword, 0.0) AS keyword, semantic, phrase, focus, round(coalesce(keyword, 0.0) * 0.45 + semantic * 0.55 + phrase + focus, 6) AS score
        FROM sn LEFT JOIN kn USING (qid, chunk_id) JOIN bo USING (qid, chunk_id)),
    hy AS ({top('fu', 30, 'query_id, rank, chunk_id, score, keyword, semantic, phrase, focus')})"""


def _concept_entities(questions=None):
    """Concepts of passages as entities, the edges between them and twelve rounds of labels."""
    return f"""{PASSAGES}, {questions or QUESTIONS}, {ALIASES}, nm0 AS (SELECT id AS key, min(concept_label) AS name FROM banking_ontology GROUP BY id),
    fo AS (SELECT * FROM (SELECT chunk_id, concept AS key, name, row_number() OVER (PARTITION BY chunk_id ORDER BY concept) AS rank FROM ({concepts_in('passages', 'chunk_id', 'text')}) JOIN nm0 ON nm0.key = concept) WHERE rank <= 18),
    names AS (SELECT key, name, count(*) AS mentions FROM fo GROUP BY key, name),
    mk AS (SELECT chunk_id, least(count(*), 12) AS k FROM fo GROUP BY chunk_id),
    edges AS (SELECT a.key AS source, b.key AS target, round(sum(1.0 / (k - 1)), 6) AS weight FROM fo a JOIN fo b ON a.chunk_id = b.chunk_id AND a.key < b.key AND a.rank <= 12 AND b.rank <= 12 JOIN mk ON mk.chunk_id = a.chunk_id GROUP BY ALL),
    bw AS (SELECT source AS u, target AS v, weight FROM edges UNION ALL SELECT target, source, weight FROM edges)"""


def _seeds():
    return f"""{words_of('qk', 'questions', 'query_id', 'question')}, {words_of('nk', 'names', 'key', 'name', 'mentions')},
    ns AS (SELECT query_id, key, mentions, {overlap('qk', 'nk')} + CASE WHEN contains(qk.tl, key) THEN 0.6 ELSE 0.0 END AS s FROM qk, nk),
    sc AS (SELECT query_id, key, round(s + least(mentions / 40.0, 0.25), 6) AS seed FROM ns WHERE s > 0),
    seeds AS (SELECT query_id, key, seed FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seed DESC, key) AS r FROM sc) WHERE r <= 8)"""


def _combined(graph):
    """The last steps of local and global retrieval over the scores ``graph``."""
    return f"""bt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scores) WHERE rank <= 40),
    gr AS (SELECT query_id, chunk_id, round(sum(score), 12) AS score FROM (SELECT query_id, chunk_id, score FROM {graph} UNION ALL SELECT query_id, chunk_id, score * 0.2 FROM bt) GROUP BY ALL),
    gm AS (SELECT query_id, min(score) AS lo, max(score) AS hi FROM gr GROUP BY query_id), bm AS (SELECT query_id, min(score) AS lo, max(score) AS hi FROM scores GROUP BY query_id),
    gn AS (SELECT query_id, chunk_id, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS g FROM gr JOIN gm USING (query_id)),
    bn AS (SELECT query_id, chunk_id, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS b FROM scores JOIN bm USING (query_id)),
    ba AS (SELECT query_id, chunk_id, g * 0.60 + coalesce(b, 0.0) * 0.40 AS base FROM gn LEFT JOIN bn USING (query_id, chunk_id)),
    {words_of('qo', 'questions', 'query_id', 'question')}, {words_of('pt', 'passages', 'chunk_id', 'text')},
    fi AS (SELECT query_id, chunk_id, round(base + 0.25 * ({raw_overlap('qo', 'pt')}), 6) AS score FROM ba JOIN qo USING (query_id) JOIN pt USING (chunk_id))
    {top('fi', 7, 'query_id, rank, chunk_id, score')}"""


OVERVIEW = "questions AS (SELECT concept_no AS query_id, 'Tổng quan các quy định về ' || concept_label AS question FROM banking_ontology)"


def _stripped(x):
    x = low(x)
    for p in sorted({*lexicon.GLOBAL_HINTS, *lexicon.FILLERS}, key=lambda y: (-len(y), y)):
        x = f"replace({x}, {_q(p)}, ' ')"
    return f"array_to_string({tokens(x)}, ' ')"


def _described():
    said = f"coalesce(list_extract({sentences('rt')}, 1), substring({clean('text')}, 1, 240))"
    return f"""{_concept_entities(OVERVIEW)}, {_labels(12)}, dg AS (SELECT u AS key, round(sum(weight), 6) AS degree FROM bw GROUP BY u),
    en AS (SELECT names.key, name, mentions, coalesce(label, names.key) AS label, coalesce(degree, 0.0) AS degree FROM names LEFT JOIN l12 ON u = names.key LEFT JOIN dg ON dg.key = names.key),
    sz AS (SELECT label, count(*) AS size FROM en GROUP BY label),
    te AS (SELECT label, string_agg(name, ', ' ORDER BY r) AS entities FROM (SELECT label, name, row_number() OVER (PARTITION BY label ORDER BY mentions DESC, degree DESC, name) AS r FROM en) WHERE r <= 10 GROUP BY label),
    bc AS (SELECT * FROM (SELECT label, chunk_id, row_number() OVER (PARTITION BY label ORDER BY s DESC, chunk_id) AS r FROM (SELECT label, chunk_id, count(*) AS s FROM fo JOIN en USING (key) GROUP BY ALL)) WHERE r <= 8),
    ne AS MATERIALIZED (SELECT chunk_id, text, {repair('text')} AS rt FROM passages WHERE chunk_id IN (SELECT chunk_id FROM bc WHERE r <= 3)),
    sd AS (SELECT chunk_id, {said} AS said FROM ne),
    xe AS (SELECT label, string_agg(said, ' ' ORDER BY r) AS e FROM bc JOIN sd USING (chunk_id) WHERE r <= 3 GROUP BY label),
    cs AS (SELECT label, string_agg(chunk_id::VARCHAR, ' ' ORDER BY r) AS chunks FROM bc GROUP BY label),
    ds AS (SELECT label, size, chunks, 'Entities: ' || entities || chr(10) || 'Key excerpts: ' || CASE WHEN length(e) > 900 THEN regexp_replace(substring(e, 1, 900), '(?s) [^ ]*$', '') ELSE coalesce(e, '') END AS summary
        FROM sz JOIN te USING (label) LEFT JOIN xe USING (label) LEFT JOIN cs USING (label)),
    aq AS (SELECT query_id, {_stripped('question')} AS asked FROM questions), {words_of('ak', 'aq', 'query_id', 'asked', 'asked')}, {words_of('dk', 'ds', 'label', 'summary', 'size')},
    co0 AS (SELECT query_id, label, round(CASE WHEN asked <> '' THEN {overlap('ak', 'dk')} ELSE 0.0 END + least(size / 80.0, 0.35), 6) AS score FROM ak, dk),
    co AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS n FROM co0 WHERE score > 0) WHERE n <= 5)"""


def _ontology():
    right = "SELECT query_id FROM iq WHERE predicate = 'has_right'"
    return f"""{ASKED}, {INDEX}, {ALIASES}, qc AS ({concepts_in('questions', 'query_id', 'question')}), cc AS ({concepts_in('ix', 'chunk_id', 'text')}), iq AS ({_intents()}),
    qr AS (SELECT DISTINCT query_id, unnest({ref_list('question')}) AS ref FROM questions), cr AS (SELECT DISTINCT chunk_id, unnest({ref_list('text')}) AS ref FROM ix),
    nd AS (SELECT DISTINCT query_id, filename AS document FROM doc_manifest JOIN qr ON ref = document_number),
    fl AS (SELECT query_id, chunk_id, (subject_id IN (SELECT concept FROM qc WHERE qc.query_id = q.query_id) OR coalesce(object_id IN (SELECT concept FROM qc WHERE qc.query_id = q.query_id), false)) AS c,
        predicate_name IN (SELECT predicate FROM iq WHERE iq.query_id = q.query_id) AS p, coalesce((SELECT bool_or(contains(object_id, ref)) FROM qr WHERE qr.query_id = q.query_id), false) AS r FROM questions q, facts),
    rw AS (SELECT query_id, chunk_id, 1.5 * count(*) AS s FROM qc JOIN cc USING (concept) GROUP BY ALL
        UNION ALL SELECT DISTINCT query_id, chunk_id, 2.0 FROM qr JOIN cr USING (ref)
        UNION ALL SELECT query_id, chunk_id, 3.0 FROM nd JOIN ix USING (document)
        UNION ALL SELECT query_id, chunk_id, CASE WHEN c THEN 1.0 ELSE 0 END + CASE WHEN p THEN 1.25 ELSE 0 END + CASE WHEN c AND p THEN 1.5 ELSE 0 END + CASE WHEN r THEN 2.0 ELSE 0 END FROM fl WHERE c OR p OR r),
    os AS (SELECT query_id, chunk_id, round(sum(s)::DOUBLE, 6) AS score FROM rw GROUP BY ALL),
    rt AS (SELECT * FROM nd WHERE query_id NOT IN (SELECT query_id FROM iq WHERE predicate = 'references'))"""


def _ontology_rank():
    scaled = lambda name, source: f"{name} AS (SELECT query_id, chunk_id, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS v FROM {source} JOIN (SELECT query_id, min(score) AS lo, max(score) AS hi FROM {source} GROUP BY query_id) USING (query_id))"
    return rf"""{_ontology()}, {bm25(folded, 'ix')}, {scaled('k', 'scores')}, {scaled('o', 'os')},
    al2 AS (SELECT query_id, chunk_id, coalesce(k.v, 0.0) AS kw, coalesce(o.v, 0.0) AS ont FROM k FULL JOIN o USING (query_id, chunk_id)),
    ck AS MATERIALIZED (SELECT chunk_id, article, document, coalesce(quality_score, {quality('text')}) AS q, {normalized('substring(text, 1, 180)')} AS opening FROM ix),
    ca AS (SELECT al2.*, question, article, document, q, opening FROM al2 JOIN ck USING (chunk_id) JOIN questions USING (query_id)),
    cb AS (SELECT * FROM ca WHERE query_id NOT IN (SELECT query_id FROM rt) OR (query_id, document) IN (SELECT (query_id, document) FROM rt)),
    fz AS (SELECT query_id, chunk_id, kw, ont, round((kw * 0.55 * CASE WHEN ont = 0 AND query_id IN (SELECT query_id FROM qc UNION SELECT query_id FROM qr) THEN 0.25 ELSE 1.0 END + ont * 0.45
        + CASE WHEN list_contains(regexp_extract_all(lower(question), 'đi[eề]u\s+([\p{{L}}\p{{N}}_]+)', 1), lower(article)) THEN 0.08 ELSE 0.0 END
        + CASE WHEN query_id IN (SELECT query_id FROM iq WHERE predicate = 'has_right') AND contains(opening, 'quyen cua') THEN 0.28 WHEN query_id IN (SELECT query_id FROM iq WHERE predicate = 'applies_to') AND contains(opening, 'doi tuong ap dung') THEN 0.16 ELSE 0.0 END)
        * (0.2 + 0.8 * q), 6) AS score FROM cb)
    {top('fz', 7, 'query_id, rank, chunk_id, score, round(kw, 6) AS kw, round(ont, 6) AS ont')}"""


def _facts():
    hit = lambda p: whole("sentence", p)
    stated = " UNION ALL ".join([f"SELECT *, '{n}' AS predicate FROM li WHERE {hit(p)}" for n, p in lexicon.PREDICATES.items()] + [
        "SELECT *, 'applies_to' FROM li WHERE contains(n, 'doi tuong ap dung')", f"SELECT *, 'defines' FROM li WHERE terms AND {hit(lexicon.DEFINING)}", "SELECT *, 'references' FROM li WHERE len(refs) > 0",
    ])
    actor = "concept_type IN (" + ", ".join(map(_q, lexicon.ACTORS)) + ")"
    return f"""WITH {DOCS}, {ALIASES}, b0 AS (SELECT doc_id, text, {ref_list('text')} AS r0 FROM docs),
    b AS (SELECT doc_id, text, list_filter(r0, lambda x, i: list_position(r0, x) = i) AS rs, contains({normalized('text')}, 'giai thich tu ngu') AS terms, list_filter({sentences('text', '.!?;:')}, lambda s: length(s) >= 20) AS s FROM b0),
    s0 AS MATERIALIZED (SELECT doc_id, rs, terms, unnest(range(0, len(s))) AS pos, unnest(s) AS sentence FROM b),
    s1 AS (SELECT *, doc_id || '#' || pos AS sid, {normalized('sentence')} AS n FROM s0),
    fo AS (SELECT DISTINCT sid, concept, max(length(alias)) OVER (PARTITION BY sid, concept) AS len FROM (SELECT sid, ' ' || n || ' ' AS t FROM s1), al WHERE alias <> '' AND contains(t, ' ' || alias || ' ')),
    ty AS (SELECT DISTINCT id AS concept, {actor} AS actor FROM banking_ontology),
    ls AS (SELECT sid, coalesce(list(concept ORDER BY len DESC, concept) FILTER (actor), []) AS actors, coalesce(list(concept ORDER BY len DESC, concept) FILTER (NOT actor), []) AS topics FROM fo JOIN ty USING (concept) GROUP BY sid),
    li AS (SELECT doc_id, pos, sentence, n, terms, coalesce(actors, []) AS actors, coalesce(topics, []) AS topics, list_filter(rs, lambda r: contains(n, {normalized('r')})) AS refs FROM s1 LEFT JOIN ls USING (sid)),
    st AS ({stated}), pr AS (SELECT * FROM st UNION ALL SELECT *, 'mentions' FROM li WHERE len(actors) + len(topics) > 0 AND (doc_id, pos) NOT IN (SELECT (doc_id, pos) FROM st)),
    ob AS (SELECT *, CASE WHEN predicate IN ('has_right', 'requires') AND len(actors) > 0 THEN actors[1] ELSE 'document:' || doc_id END AS subject, unnest((CASE WHEN len(topics) > 0 THEN topics WHEN len(actors) > 0 THEN actors ELSE refs END)[1:5]) AS target FROM pr)
    SELECT subject, predicate, CASE WHEN list_contains(refs, target) THEN 'legal_document:' || target ELSE target END AS object, doc_id, pos, substring(sentence, 1, 700) AS sentence, CASE WHEN predicate = 'mentions' THEN 0.65 ELSE 0.9 END::DOUBLE AS confidence FROM ob WHERE target <> subject"""


def filename_ref(x):
    name = f"upper({fold(rf"regexp_replace({x}, '\.[^.]*$', '')")})"
    part = lambda i: f"regexp_extract({name}, {_q(lexicon.FILE_NUMBER)}, {i})"
    return f"CASE WHEN {part(1)} <> '' THEN {part(1)} || '/' || {part(2)} || '/' || CASE {part(3)} WHEN 'ND' THEN 'NĐ' WHEN 'QD' THEN 'QĐ' ELSE {part(3)} END || '-' || {part(4)} END"


def _quality_rows():
    noisy = rf"len(list_filter({raw_words('text')}, lambda w: length(w) > 2 AND (length(regexp_replace(w, '[^\p{{L}}]+', '', 'g')) < length(w) * 0.55 OR regexp_matches(w, '\d.*[A-Za-z].*\d'))))"
    return f"""qx AS (SELECT doc_id, CASE WHEN length({strip('text')}) >= 40 THEN 1.0 ELSE 0.0 END AS c, len({raw_words('text')}) AS w, {noisy} AS n FROM docs),
        qz AS (SELECT doc_id, round(greatest(0.0, least(1.0, c * (1 - least(0.8, 4.0 * n / greatest(w, 1))))), 3) AS quality FROM qx),
        qy AS (SELECT doc_id, quality, CASE WHEN quality >= 0.75 THEN 'good' WHEN quality >= 0.45 THEN 'review' ELSE 'poor' END AS status FROM qz)"""


def _modes():
    hints = " OR ".join(f"contains(' ' || {normalized('question')} || ' ', ' {h} ')" for h in lexicon.GLOBAL_HINTS)
    return f"""WITH {QUESTIONS}, both_ AS (SELECT * FROM questions UNION ALL SELECT query_id + 100000, 'Tổng quan các quy định về ' || question FROM questions)
        SELECT query_id, CASE WHEN {hints} THEN 'global' ELSE 'local' END AS mode, {_stripped('question')} AS stripped FROM both_"""


def oracle_sql() -> dict:
    d = lambda out, x: f"WITH {DOCS} SELECT doc_id, {x} AS {out} FROM docs"
    joined = lambda x: f"array_to_string({x}, ' ')"
    refs = rf"list_transform(regexp_extract_all(upper({fold('text')}), {_q(lexicon.LEGAL_NUMBER)}, 1), lambda r: replace(replace(regexp_replace(r, '\s+', '', 'g'), 'ND-', 'NĐ-'), 'QD-', 'QĐ-'))"
    name = f"upper({fold(rf'''regexp_replace(filename, '\.[^.]*$', '')''')})"
    part = lambda i: f"regexp_extract({name}, {_q(lexicon.FILE_NUMBER)}, {i})"
    predicates = " UNION ALL ".join(f"SELECT doc_id, pos, '{n}' AS predicate FROM se WHERE regexp_matches(sentence, {_q(r'(?i)(^|[^\p{L}\p{N}_])' + p + r'([^\p{L}\p{N}_]|$)')})" for n, p in lexicon.PREDICATES.items())
    noisy = rf"len(list_filter({raw_words('text')}, lambda w: length(w) > 2 AND (length(regexp_replace(w, '[^\p{{L}}]+', '', 'g')) < length(w) * 0.55 OR regexp_matches(w, '\d.*[A-Za-z].*\d'))))"
    chunks = "ix AS (SELECT DISTINCT ON (id) id AS chunk_id, document, page, chunk_on_page, article, text FROM chunks WHERE text IS NOT NULL)"
    block = "'[' || rank || '] ' || doc_id || ' p.1 chunk ' || chunk_on_page || chr(10)"
    sep = "chr(10) || chr(10)"
    packed = lambda source, budget: f"(SELECT query_id, rank, substring(block, 1, {budget} - before) AS block FROM (SELECT *, coalesce(sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM {source}) WHERE before < {budget})"
    hashed = lambda source: f"SELECT query_id, length(context) AS chars, md5(context) AS hash FROM {source}"
    joined_blocks = lambda source: f"(SELECT query_id, string_agg(block, {sep} ORDER BY rank) AS context FROM {source} GROUP BY query_id)"
    lines = f"""z0 AS (SELECT query_id, question, rank, {sentences('text')} AS s FROM ranked), z1 AS (SELECT query_id, question, rank, unnest(s) AS sentence, unnest(range(0, len(s))) AS pos FROM z0),
        zq AS MATERIALIZED (SELECT query_id, list_distinct({dual('question')}) AS qw FROM questions),
        z2 AS (SELECT z1.*, len(list_intersect(qw, {dual('sentence')})) AS shared FROM z1 JOIN zq USING (query_id)),
        z3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, rank, lower(sentence) ORDER BY shared DESC, length(sentence), pos) AS d FROM z2) WHERE d = 1),
        z4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY shared DESC, length(sentence), pos) AS w FROM z3) WHERE shared > 0 OR w = 1),
        z5 AS (SELECT query_id, rank, '[' || rank || '] ' || sentence AS line, row_number() OVER (PARTITION BY query_id, rank ORDER BY shared DESC, length(sentence), pos) AS w FROM z4),
        z6 AS (SELECT query_id, line, row_number() OVER (PARTITION BY query_id ORDER BY rank, w) AS n, sum(length(line) + 3) OVER (PARTITION BY query_id ORDER BY rank, w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM z5 WHERE w <= 8),
        lines AS (SELECT query_id, n, line FROM z6 WHERE used <= 4500)"""
    mark = rf"regexp_replace(text, '(^|[^\p{{L}}\p{{N}}_])(đi[eề]u{_BL}+\d+)', '\1' || chr(1) || '\2', 'gi')"
    lead = "substring(text, 1, 10000)"
    name_ref = filename_ref("name")
    issuers = "(SELECT list(id ORDER BY id) FROM (SELECT DISTINCT id FROM banking_ontology WHERE concept_type = 'Authority' ORDER BY id LIMIT 3))"
    out = {
        "clean_text": d("clean", clean("text")), "clean_text_dehyphen": d("clean", dehyphen("text")), "accent_fold": d("folded", fold("lower(text)")), "normalized": d("form", normalized("text")),
        "tokens_basic": d("toks", joined(tokens("text"))), "tokens_dual": d("toks", joined(dual("text"))), "tokens_folded": d("toks", joined(folded("text"))),
        "token_bigrams": f"WITH {DOCS}, t AS (SELECT doc_id, {dual('text')} AS t FROM docs) SELECT doc_id, array_to_string(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), ' ') AS pairs FROM t",
        "text_quality": d("quality", quality("text")), "ocr_repair": d("repaired", repair("text")), "promulgation_date": d("dated", dates("text")),
        "doc_type": d("kind", doc_types("text")),
        "char_ngrams": f"""WITH {DOCS}, s AS (SELECT doc_id, regexp_replace({strip(fold('lower(text)'))}, '{_BL}+', ' ', 'g') AS s FROM docs),
            g AS (SELECT doc_id, flatten(list_transform([3, 4, 5], lambda k: list_filter(list_transform(range(1, length(s) - k + 2), lambda i: substring(s, i, k)), lambda x: NOT starts_with(x, ' ') AND NOT ends_with(x, ' ')))) AS g FROM s)
            SELECT doc_id, len(g) AS grams, len(list_distinct(g)) AS distinct_grams FROM g""",
        "sentence_split": f"WITH {DOCS}, s AS (SELECT doc_id, {sentences('text')} AS s FROM docs) SELECT doc_id, unnest(range(0, len(s))) AS pos, unnest(s) AS sentence FROM s",
        "chunk_words": f"WITH {PASSAGES} SELECT doc_id, chunk_on_page, chunk_id, len({words('text')}) AS n_words, md5(text) AS hash FROM passages",
        "chunk_merge": "WITH " + PASSAGES.split("pi AS")[0].rstrip().rstrip(",") + " SELECT doc_id, md5(array_to_string(w, ' ')) AS hash FROM pw",
        "min_page_filter": f"SELECT count(*) AS pages, count_if(length({clean('text')}) >= 40) AS kept, count_if(coalesce(length({clean('text')}), 0) < 40) AS skipped FROM documents",
        "term_counts": f"WITH {PASSAGES} SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({tokens('text')}) AS term FROM passages) GROUP BY ALL",
        "doc_freq": f"WITH {PASSAGES} SELECT term, count(DISTINCT chunk_id) AS df FROM (SELECT chunk_id, unnest({tokens('text')}) AS term FROM passages) GROUP BY term",
        "corpus_stats": f"WITH {PASSAGES} SELECT count(*) AS chunks, sum(n)::BIGINT AS tokens, round(avg(n), 6) AS avg_length FROM (SELECT len({tokens('text')}) AS n FROM passages) WHERE n > 0",
        "document_stats": f"SELECT document, count(DISTINCT page) AS pages, count(DISTINCT CASE WHEN length({clean('text')}) >= 40 THEN page END) AS text_pages, count(DISTINCT id) AS chunks FROM chunks GROUP BY document",
        "doc_quality": f"""WITH {DOCS}, x AS (SELECT doc_id, CASE WHEN length({strip('text')}) >= 40 THEN 1.0 ELSE 0.0 END AS c, len({raw_words('text')}) AS w, {noisy} AS n FROM docs),
            y AS (SELECT doc_id, round(greatest(0.0, least(1.0, c * (1 - least(0.8, 4.0 * n / greatest(w, 1))))), 3) AS quality FROM x)
            SELECT doc_id, quality, CASE WHEN quality >= 0.75 THEN 'good' WHEN quality >= 0.45 THEN 'review' ELSE 'poor' END AS status FROM y""",
        "article_carry": "WITH c AS (SELECT DISTINCT ON (id) id, document, page, chunk_on_page, article FROM chunks) SELECT id, last_value(article IGNORE NULLS) OVER (PARTITION BY document ORDER BY page, chunk_on_page, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS article FROM c",
        "legal_refs": f"""WITH {DOCS}, r AS (SELECT doc_id, {refs} AS r FROM docs), u AS (SELECT doc_id, unnest(r) AS ref, unnest(range(0, len(r))) AS i FROM r), f AS (SELECT doc_id, ref, min(i) AS i FROM u GROUP BY ALL)
            SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, ref FROM f""",
        "filename_refs": f"SELECT DISTINCT filename, CASE WHEN {part(1)} <> '' THEN {part(1)} || '/' || {part(2)} || '/' || CASE {part(3)} WHEN 'ND' THEN 'NĐ' WHEN 'QD' THEN 'QĐ' ELSE {part(3)} END || '-' || {part(4)} END AS ref FROM doc_manifest",
        "minmax": f"""WITH {PASSAGES}, {QUESTIONS}, {bm25(tokens)}, m AS (SELECT query_id, min(score) AS lo, max(score) AS hi FROM scores GROUP BY query_id)
            SELECT query_id, chunk_id, CASE WHEN hi = lo THEN 1.0 ELSE round((score - lo) / (hi - lo), 6) END AS norm FROM scores JOIN m USING (query_id)""",
        "context_pack": f"""WITH {RANKED}, b AS (SELECT query_id, rank, '[' || rank || '] ' || text AS block FROM ranked), c AS (SELECT *, coalesce(sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM b),
            t AS (SELECT query_id, rank, substring(block, 1, 6000 - before) AS block FROM c WHERE before < 6000) SELECT query_id, rank, length(block) AS chars, md5(block) AS hash FROM t""",
        "best_sentences": f"""WITH {RANKED}, s0 AS (SELECT query_id, question, rank, {sentences('text')} AS s FROM ranked),
            s AS (SELECT query_id, question, rank, unnest(s) AS sentence, unnest(range(0, len(s))) AS pos FROM s0),
            o AS (SELECT *, len(list_intersect(list_distinct({tokens('question')}), {tokens('sentence')})) AS shared FROM s),
            u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(sentence) ORDER BY rank, shared DESC, length(sentence), pos) AS dd FROM o) WHERE dd = 1),
            w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, shared DESC, length(sentence), pos) AS ww FROM u) WHERE shared > 0 OR ww = 1)
            SELECT query_id, n, sentence FROM (SELECT query_id, sentence, row_number() OVER (PARTITION BY query_id ORDER BY rank, shared DESC, length(sentence), pos) AS n FROM w) WHERE n <= 5""",
        "citations": f"WITH {chunks} SELECT chunk_id AS id, document || ' p.' || page || ' chunk ' || chunk_on_page AS citation, document || ', trang ' || page || CASE WHEN coalesce(article, '') <> '' THEN ', Điều ' || article ELSE '' END AS legal_citation, substring({clean('text')}, 1, 420) AS preview FROM ix",
        "inspect_stats": "WITH m AS (SELECT DISTINCT ON (id) * FROM doc_manifest) SELECT count(*) AS documents, sum(chunks)::BIGINT AS chunks, count_if(quality_status = 'review') AS review, count_if(document_number IS NULL) AS unnumbered, (SELECT count(*) FROM facts) AS facts FROM m",
        "dense_topk": f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0),
            s AS (SELECT query_id, vec_id, round(list_inner_product(q.e, v.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v.e, v.e))), 6) AS score FROM q, (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) v) {top('s', 5, 'query_id, rank, vec_id, score', 'vec_id')}""",
        "entity_members": f"WITH {MEMBERS} SELECT * FROM members", "cooc_edges": f"WITH {EDGES} SELECT source, target, weight FROM edges",
        "weighted_degree": f"WITH {EDGES} SELECT u AS key, round(sum(weight), 6) AS degree FROM bw GROUP BY u",
        "label_propagation": f"WITH {EDGES}, {_labels(12)} SELECT u AS key, label FROM l12",
        "community_table": f"""WITH {EDGES}, {_labels(12)}, dg AS (SELECT u AS key, round(sum(weight), 6) AS degree FROM bw GROUP BY u),
            x AS (SELECT label, key, row_number() OVER (PARTITION BY label ORDER BY degree DESC, key) AS r FROM l12 JOIN dg ON dg.key = l12.u)
            SELECT label, count(*) AS size, string_agg(key, ' ' ORDER BY r) FILTER (r <= 12) AS top FROM x GROUP BY label HAVING count(*) > 1""",
        "concept_match": f"WITH {DOCS}, {ALIASES} {concepts_in('docs', 'doc_id', 'text')}",
        "query_semantics": f"""WITH {ASKED}, {ALIASES} SELECT query_id, 'concept' AS kind, concept AS value FROM ({concepts_in('questions', 'query_id', 'question')}) UNION ALL SELECT query_id, 'intent', predicate FROM ({_intents()})
            UNION ALL SELECT DISTINCT query_id, 'reference', unnest({ref_list('question')}) FROM questions""",
        "concept_check": "SELECT 'null id' AS problem, id FROM banking_ontology WHERE id IS NULL UNION ALL SELECT 'duplicate id' AS problem, id FROM banking_ontology WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'no type or label' AS problem, id FROM banking_ontology WHERE concept_type IS NULL OR concept_label IS NULL UNION ALL SELECT 'unknown type' AS problem, id FROM banking_ontology WHERE concept_type NOT IN (" + ", ".join(_q(t) for ts in lexicon.ENTITY_TYPES.values() for t in ts) + ")",
        "concept_types": "SELECT concept_type, count(*) AS concepts, concept_type IN (" + ", ".join(_q(t) for ts in lexicon.ENTITY_TYPES.values() for t in ts) + ") AS known FROM banking_ontology GROUP BY concept_type",
        "sentence_predicates": f"WITH {DOCS}, s0 AS (SELECT doc_id, list_filter({sentences('text', '.!?;:')}, lambda s: length(s) >= 20) AS s FROM docs), se AS (SELECT doc_id, unnest(range(0, len(s))) AS pos, unnest(s) AS sentence FROM s0) {predicates}",
        "predicate_counts": "SELECT predicate_name, count(*) AS facts, count(DISTINCT subject_id) AS subjects FROM facts GROUP BY predicate_name",
    }
    out |= {
        "bm25_occurrences": f"WITH {PASSAGES}, {QUESTIONS}, {bm25(folded, df='sum(tf)')}, nz AS (SELECT * FROM scores WHERE score <> 0) {top('nz', 7, 'query_id, rank, chunk_id, score')}",
        "article_segments": f"""WITH {chunks}, m AS (SELECT *, {mark} AS t FROM ix), p AS (SELECT *, string_split(CASE WHEN starts_with(t, chr(1)) THEN substring(t, 2) ELSE t END, chr(1)) AS ps FROM m),
            u AS (SELECT chunk_id, document, page, chunk_on_page, unnest(range(0, len(ps))) AS pos, unnest(ps) AS segment FROM p),
            a AS (SELECT *, nullif(regexp_extract(segment, '(?i)^đi[eề]u{_BL}+(\\d+[a-zđ]?)', 1), '') AS own FROM u),
            c AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY document ORDER BY page, chunk_on_page, chunk_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS article FROM a)
            SELECT chunk_id AS id, pos, article, length(segment) AS chars, md5(segment) AS hash FROM c WHERE length({strip('segment')}) >= 20""".replace("\\\\d", "\\d"),
        "query_rewrite": f"WITH {QUESTIONS}, {_variants()} SELECT query_id, variant, weight, question FROM variants",
        "feature_df": f"WITH {_frequencies()} SELECT substring(f, 1, 1) AS kind, count(DISTINCT f) AS features, count(*) AS pairs, round(sum(tf), 3) AS weight FROM fc GROUP BY kind",
        "feature_counts": f"WITH {_frequencies()} SELECT df AS n, count(*) AS features FROM fd GROUP BY df",
        "hashed_vector": f"WITH {_frequencies()}, qf AS ({_features('questions', 'query_id', 'question')}), {_vectors('qv', 'qf', 'query_id')} SELECT query_id, idx, round(val, 6) AS val FROM qv",
        "sparse_topk": f"""WITH {_frequencies()}, qf AS ({_features('questions', 'query_id', 'question')}), {_vectors('cv', 'fc', 'chunk_id')}, {_vectors('qv', 'qf', 'query_id')},
            se AS (SELECT query_id, chunk_id, greatest(0.0, round(sum(cv.val * qv.val), 6)) AS score FROM cv JOIN qv USING (idx) GROUP BY ALL) {top('se', 5, 'query_id, rank, chunk_id, score')}""",
        "bonuses": f"""WITH {RANKED}, {words_of('qk', 'questions', 'query_id', 'question')}, {words_of('rk', 'ranked', 'query_id', 'text', 'chunk_id')}, q AS (SELECT query_id, tl AS l, tw AS w FROM qk), t AS (SELECT query_id, chunk_id, tl AS l FROM rk),
            ov AS (SELECT query_id, chunk_id, {overlap('qk', 'rk')} AS overlap FROM qk JOIN rk USING (query_id))
            SELECT query_id, chunk_id, {_bonus_columns()}, overlap FROM q JOIN t USING (query_id) JOIN ov USING (query_id, chunk_id)""",
        "hybrid_topk": f"WITH {_hybrid()} SELECT query_id, rank, chunk_id, score, round(keyword, 6) AS keyword, round(semantic, 6) AS semantic, phrase, focus FROM hy",
        "rerank_topk": f"""WITH {_hybrid()}, rr AS (SELECT query_id, chunk_id, score AS first, phrase, focus, list_distinct({dual('question')}) AS q, list_distinct({dual('text')}) AS t FROM hy JOIN questions USING (query_id) JOIN passages USING (chunk_id)),
            rs AS (SELECT query_id, chunk_id, first, round(first + 0.25 * len(list_intersect(q, t)) / greatest(len(q), 1) + 0.10 * len(list_intersect(q, t)) / greatest(len(t), 1) + phrase + focus, 6) AS score FROM rr) {top('rs', 6, 'query_id, rank, chunk_id, score, first')}""",
        "edge_units": f"""WITH {EDGES}, pa AS (SELECT a.key AS source, b.key AS target, a.unit FROM mr a JOIN mr b ON a.unit = b.unit AND a.key < b.key)
            SELECT source, target, unit, n FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY unit) AS n FROM pa) WHERE n <= 10""",
        "relationships": f"WITH {EDGES} SELECT source, target, weight FROM edges ORDER BY weight DESC, source, target LIMIT 100",
        "concept_names": f"WITH {_concept_entities()} SELECT key, name, mentions FROM names",
        "seed_entities": f"WITH {_concept_entities()}, {_seeds()} SELECT query_id, key, seed FROM seeds",
        "local_retrieve": f"""WITH {_concept_entities()}, {_seeds()}, {bm25(folded)},
            fb AS (SELECT query_id, key, 0.35 AS seed FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM scores) b JOIN fo USING (chunk_id) WHERE r <= 7 AND rank <= 3 AND query_id NOT IN (SELECT query_id FROM seeds)),
            sa AS (SELECT * FROM seeds UNION ALL SELECT * FROM fb),
            nb AS (SELECT u, v, weight FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY weight DESC, v) AS r FROM bw) WHERE r <= 8),
            g0 AS (SELECT query_id, chunk_id, seed AS s FROM sa JOIN fo USING (key) UNION ALL SELECT query_id, chunk_id, 0.35 * seed * weight FROM sa JOIN nb ON u = sa.key JOIN fo ON fo.key = v),
            g1 AS (SELECT query_id, chunk_id, round(sum(s), 12) AS score FROM g0 GROUP BY ALL), {_combined('g1')}""",
        "community_description": f"WITH {_described()} SELECT label, size, chunks, md5(summary) AS hash FROM ds",
        "community_scores": f"WITH {_described()} SELECT query_id, label, score, n FROM co",
        "global_retrieve": f"WITH {_described()}, {bm25(folded)}, g1 AS (SELECT query_id, chunk_id, score / r AS score FROM co JOIN bc USING (label)), {_combined('g1')}",
        "mode_choice": _modes(),
        "ontology_scores": f"WITH {_ontology()} SELECT query_id, chunk_id, score FROM os",
        "doc_routing": f"WITH {_ontology()} SELECT query_id, document FROM rt",
        "ontology_topk": f"WITH {_ontology_rank()}",
        "sentence_facts": _facts(),
        "document_metadata": f"""WITH {ALIASES}, docs AS (SELECT doc_id, text, replace(coalesce(document_number, ''), '/', '.') AS name FROM documents WHERE text IS NOT NULL), {_quality_rows()},
            iss AS (SELECT doc_id, min(list_position({issuers}, concept)) AS i FROM ({concepts_in('docs', 'doc_id', 'text')}) WHERE list_contains({issuers}, concept) GROUP BY doc_id)
            SELECT doc_id, coalesce({name_ref}, list_extract({ref_list(f"regexp_extract({lead}, '(?is)^(.*?)(?:$|(?:^|[^' || chr(92) || 'p{{L}}' || chr(92) || 'p{{N}}_])căn[' || chr(92) || 's]+cứ(?:$|[^' || chr(92) || 'p{{L}}' || chr(92) || 'p{{N}}_]))', 1)")}, 1)) AS document_number,
            {doc_types(f"regexp_replace(name, '[.][^.]*$', '') || ' ' || {lead}")} AS document_type, {issuers}[i] AS issuer, {dates(lead)} AS promulgation_date, quality, status FROM docs LEFT JOIN iss USING (doc_id) JOIN qy USING (doc_id)""",
        "ontology_sentences": f"""WITH {RANKED}, rp AS MATERIALIZED (SELECT query_id, question, rank, {repair('text')} AS t FROM ranked),
            s0 AS (SELECT query_id, question, rank, list_filter({sentences('t', '.!?;:')}, lambda s: length(s) >= 35) AS s FROM rp), s1 AS (SELECT query_id, question, rank, unnest(s) AS sentence, unnest(range(0, len(s))) AS pos FROM s0),
            sq AS MATERIALIZED (SELECT query_id, {ref_list('question')} AS qr, list_distinct({folded('question')}) AS q FROM questions),
            s2 AS (SELECT s1.*, qr, q, {ref_list('sentence')} AS sr FROM s1 JOIN sq USING (query_id)), s3 AS (SELECT * FROM s2 WHERE len(qr) = 0 OR len(sr) = 0 OR list_has_any(qr, sr)),
            s4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, {normalized('sentence')} ORDER BY rank, pos) AS d FROM s3) WHERE d = 1),
            s5 AS (SELECT query_id, sentence, rank, round(len(list_intersect(q, {folded('sentence')})) / greatest(len(q), 1) + 0.15 / rank, 6) AS score FROM s4)
            SELECT query_id, n, sentence, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sentence DESC, rank DESC) AS n FROM s5) WHERE n <= 6""",
        "format_context": f"WITH {RANKED}, b AS (SELECT query_id, rank, {block} || substring({clean('text')}, 1, 2500) AS block FROM ranked) {hashed(joined_blocks('b'))}",
        "compressed_context": f"WITH {RANKED}, {lines} SELECT query_id, n, line FROM lines",
        "llm_context": f"""WITH {RANKED}, {lines}, b AS (SELECT query_id, rank, {block} || text AS block FROM ranked), p AS (SELECT * FROM {packed('b', 2500)}),
            j AS (SELECT query_id, context, used, 'Compressed relevant sentences:' || chr(10) || coalesce(c, '') AS first FROM {joined_blocks('p')} JOIN (SELECT query_id, sum(length(block)) AS used FROM p GROUP BY query_id) USING (query_id)
                LEFT JOIN (SELECT query_id, string_agg('- ' || line, chr(10) ORDER BY n) AS c FROM lines GROUP BY query_id) USING (query_id)),
            o AS (SELECT query_id, CASE WHEN used + length(first) <= 2500 THEN first || {sep} || context ELSE context END AS context FROM j) {hashed('o')}""",
        "graph_context": f"""WITH {RANKED}, {_concept_entities().replace(PASSAGES + ', ' + QUESTIONS + ', ', '')}, ns AS (SELECT chunk_id, string_agg(name, ', ' ORDER BY rank) AS names FROM fo WHERE rank <= 8 GROUP BY chunk_id),
            b AS (SELECT query_id, rank, {block} || 'Entities: ' || coalesce(names, '') || chr(10) || {repair('text')} AS block FROM ranked LEFT JOIN ns USING (chunk_id)), p AS (SELECT * FROM {packed('b', 7000)}) {hashed(joined_blocks('p'))}""",
        "ontology_context": f"""WITH {QUESTIONS}, {INDEX}, {ALIASES}, {bm25(folded, 'ix')}, tops AS ({top('scores', 7, 'query_id, chunk_id, rank')}),
            need AS MATERIALIZED (SELECT chunk_id, text, {repair('text')} AS rt FROM ix WHERE chunk_id IN (SELECT chunk_id FROM tops)),
            cl AS (SELECT chunk_id, string_agg(concept_label, ', ' ORDER BY length(alias) DESC, concept, concept_label) AS labels FROM ({concepts_in('need', 'chunk_id', 'text')}) JOIN banking_ontology o ON o.id = concept GROUP BY chunk_id),
            nu AS (SELECT filename AS document, min(document_number) AS document_number FROM doc_manifest WHERE document_number IS NOT NULL GROUP BY filename),
            b AS (SELECT query_id, rank, '[' || rank || '] ' || document || ', trang ' || page || CASE WHEN coalesce(article, '') <> '' THEN ', Điều ' || article ELSE '' END
                || CASE WHEN coalesce(document_number, '') <> '' THEN chr(10) || 'Verified document number from manifest: ' || document_number ELSE '' END
                || CASE WHEN coalesce(labels, '') <> '' THEN chr(10) || 'Ontology concepts: ' || labels ELSE '' END || chr(10) || rt AS block
                FROM tops JOIN ix USING (chunk_id) JOIN need USING (chunk_id) LEFT JOIN cl USING (chunk_id) LEFT JOIN nu USING (document)),
            o AS (SELECT query_id, substring(context, 1, 8000) AS context FROM {joined_blocks('b')}) {hashed('o')}""",
    }
    for name, f in (("bm25_topk", tokens), ("bm25_dual", dual), ("bm25_folded", folded)):
        out[name] = f"WITH {PASSAGES}, {QUESTIONS}, {bm25(f)} {top('scores', 5, 'query_id, rank, chunk_id, score')}"
    return out
