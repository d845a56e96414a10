"""SQL, as DuckDB runs it, for the operators that SQL can express."""

from __future__ import annotations

from weftgraph.llm.chat_format import CONTEXT_ROLES, END, ESCAPED, MARK, NAME_CODES, NAMELESS, PART, START
from weftgraph.llm.minhash import SHINGLE, SIMILAR
from weftgraph.llm.quality_rules import CHARACTER_CLASSES, COMMON_WORDS, SPACE_CLASS, SYMBOLS, WINDOW
from weftgraph.llm.vector_dedup import SIMILAR as SIMILAR_VECTORS

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text,''), '[\x20\x09-\x0D]+'), lambda x: x<>'')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _distance(p: str, q: str) -> str:
    """The Jensen-Shannon distance of two lists of counts, null if one sums up to 0."""
    share = lambda a: f"list_transform({a}, lambda x: x/list_sum({a}))"
    part = lambda a, b: f"CASE WHEN {a}>0 THEN {a}*log2(2*{a}/({a}+{b})) ELSE 0.0 END"
    pairs = f"list_zip({share(p)}, {share(q)})"
    terms = f"list_transform({pairs}, lambda z: ({part('z[1]', 'z[2]')}+{part('z[2]', 'z[1]')})/2)"
    return f"CASE WHEN list_sum({p})>0 AND list_sum({q})>0 THEN round(sqrt(greatest(0.0, list_sum({terms}))),6) END"


def quality_rules_sql(max_chars: float = 0.26, max_words: float = 0.32, max_both: float = 0.47, min_chars: int = 300, min_words: int = 60, min_reference: int = 5000, refine: tuple[float, ...] = (0.35, 0.25)) -> str:
    count = lambda c: f"length(regexp_replace(t, {_quoted(f'[^{c}]+')}, '', 'g'))"
    classes = ", ".join(count(c) for c in CHARACTER_CLASSES)
    lists = " ".join(f"WHEN {_quoted(code)} THEN [{', '.join(map(_quoted, ws))}]" for code, ws in COMMON_WORDS.items())
    width = {"classes": len(CHARACTER_CLASSES) + 1, "words": max(map(len, COMMON_WORDS.values())) + 1}

    def reference(source: str, where: str) -> str:
        sums = ", ".join(f"list_filter([{', '.join(f'CAST(sum({c}[{i + 1}]) AS DOUBLE)' for i in range(n))}], lambda x: x IS NOT NULL) AS ref_{c}" for c, n in width.items())
        return f"SELECT lang, {sums} FROM {source} WHERE {where} GROUP BY lang"

    def against(ref: str) -> str:
        return f"SELECT c.*, ref_words, {_distance('classes', 'ref_classes')} AS js_chars, {_distance('words', 'ref_words')} AS js_words FROM counts c LEFT JOIN {ref} USING (lang)"

    steps = ["r0 AS (" + reference("counts", "NOT base_failed") + ")"]
    for k, limit in enumerate(refine):
        steps.append(f"d{k} AS ({against(f'r{k}')})")
        steps.append(f"r{k + 1} AS (" + reference(f"d{k}", f"NOT base_failed AND js_chars<={limit} AND coalesce(js_words<={limit}, true)") + ")")
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang,'') AS lang, coalesce(text,'') AS t, {_WORDS} AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i+{WINDOW - 1}], ' ') AS key FROM (SELECT r, w, unnest(range(1, len(w)-{WINDOW - 2})) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, key) AS k FROM win) WHERE k>1),
rep AS (SELECT r, count(DISTINCT i+j) AS n_repeat_words FROM twice, range({WINDOW}) AS s(j) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
found AS (SELECT d.r, doc_id, lang, len(w) AS n_words, length(t)-{count(SPACE_CLASS)} AS word_chars, {count(SYMBOLS)} AS n_symbols, len(l)-len(list_distinct(l)) AS n_dup_lines,
  coalesce(n_repeat_words,0) AS n_repeat_words, [{classes}, 0] AS cl, length(t) AS n_chars,
  list_transform(coalesce(CASE lang {lists} END, []), lambda c: len(list_filter(w, lambda x: lower(x)=c))) AS cw FROM d JOIN lines USING (r) LEFT JOIN rep USING (r)),
counts AS (SELECT *, list_transform(list_concat(cl[:-2], [n_chars-CAST(list_sum(cl) AS BIGINT)]), lambda x: CAST(x AS DOUBLE)) AS classes,
  list_transform(list_concat(cw, [n_words-coalesce(CAST(list_sum(cw) AS BIGINT),0)]), lambda x: CAST(x AS DOUBLE)) AS words,
  n_words<10 OR 100*n_repeat_words>20*n_words AS base_failed FROM found),
{", ".join(steps)},
j AS ({against(f"r{len(refine)}")})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, js_chars, js_words,
  NOT base_failed AND NOT coalesce(list_sum(ref_words)>={min_reference} AND word_chars>={min_chars} AND js_chars>{max_chars}, false)
  AND NOT coalesce(list_sum(ref_words)>={min_reference} AND n_words>={min_words} AND len(words)>1 AND js_words>{max_words}, false)
  AND NOT coalesce(list_sum(ref_words)>={min_reference} AND word_chars>={min_chars} AND n_words>={min_words} AND len(words)>1 AND js_chars+js_words>{max_both}, false) AS kept FROM j"""


def vector_dedup_sql() -> str:
    return f"""WITH RECURSIVE x AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e,e)) AS l FROM x WHERE len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c)))=0 AND len(list_filter(e, lambda c: c<>0))>0),
b AS (SELECT a.vec_id AS src, z.vec_id AS dst FROM n a JOIN n z ON a.vec_id<>z.vec_id WHERE list_dot_product(a.e,z.e)/(a.l*z.l)>={SIMILAR_VECTORS}),
cc(v,label) USING KEY (v) AS (SELECT vec_id, vec_id FROM embeddings
  UNION SELECT b.dst, min(cc.label) FROM cc JOIN b ON cc.v=b.src JOIN recurring.cc r ON r.v=b.dst WHERE cc.label<r.label GROUP BY b.dst)
SELECT v AS vec_id, (SELECT count(*) FROM b WHERE src=v) AS n_links, label AS component_id, v=label AS kept FROM cc"""


def minhash_sql() -> str:
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, sh, count(*) AS n FROM (SELECT doc_id, array_to_string(w[i:i+{SHINGLE - 1}], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w)-{SHINGLE - 1})+1)) AS i FROM d WHERE len(w)>0)) GROUP BY doc_id, sh),
t AS (SELECT doc_id, sum(n) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n,b.n)) AS n FROM s a JOIN s b ON a.sh=b.sh AND a.doc_id<b.doc_id GROUP BY 1,2),
l AS (SELECT x, y FROM c JOIN t tx ON tx.doc_id=x JOIN t ty ON ty.doc_id=y WHERE c.n/(tx.n+ty.n-c.n)>={SIMILAR}),
b AS (SELECT x AS src, y AS dst FROM l UNION ALL SELECT y, x FROM l),
cc(v,label) USING KEY (v) AS (SELECT doc_id, doc_id FROM documents
  UNION SELECT b.dst, min(cc.label) FROM cc JOIN b ON cc.v=b.src JOIN recurring.cc r ON r.v=b.dst WHERE cc.label<r.label GROUP BY b.dst)
SELECT v AS doc_id, label AS class_id, v=label AS kept FROM cc"""


def chat_format_sql() -> str:
    context = ", ".join(map(_quoted, CONTEXT_ROLES))
    name = "role"
    for c, code in NAME_CODES.items():
        name = f"replace({name}, chr({ord(c)}), '{code}')"
    head = f"'{START}' || CASE WHEN role=perspective THEN 'assistant' WHEN role IN ({context}) THEN role ELSE 'user name=' || CASE WHEN role='' THEN '{NAMELESS}' ELSE {name} END END || chr(10)"
    order = "turn NULLS FIRST, role, text"
    return f"""WITH u AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY {order})-1 AS k FROM u),
sc AS (SELECT conv_id AS sc_of, min(k) AS sc_k, arg_min(text, k) AS sc_text, arg_min(role, k) AS sc_role FROM n WHERE role IN ({context}) GROUP BY conv_id),
p AS (SELECT DISTINCT conv_id AS c, role AS perspective FROM u WHERE role NOT IN ({context})),
s AS (SELECT n.*, k//{PART} AS part, perspective, role=perspective AS own, replace(text, '{MARK}', '{ESCAPED}') || '{END}' AS body, {head} AS head FROM n JOIN p ON conv_id IS NOT DISTINCT FROM c),
o AS (SELECT *, coalesce(sum(length(head)+length(body)+1) OVER (PARTITION BY conv_id, part, perspective ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)+length(head) AS start_at FROM s),
v AS (SELECT conv_id, perspective, part, count(*) AS n_turns, min(k) AS first_k, string_agg(head || body || chr(10), '' ORDER BY k) AS text,
  coalesce(string_agg(CAST(start_at AS BIGINT) || '-' || CAST(start_at+length(body) AS BIGINT), ',' ORDER BY k) FILTER (WHERE own), '') AS spans,
  CAST(coalesce(sum(length(body)) FILTER (WHERE own), 0) AS BIGINT) AS n_masked FROM o GROUP BY conv_id, part, perspective)
SELECT conv_id, perspective, part, n_turns, CASE WHEN sc_k<first_k THEN '{START}' || sc_role || chr(10) || replace(sc_text, '{MARK}', '{ESCAPED}') || '{END}' || chr(10) ELSE '' END AS context, text, spans, n_masked
FROM v LEFT JOIN sc ON conv_id IS NOT DISTINCT FROM sc_of"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality_rules_sql(),
        "op3_vector_dedup": vector_dedup_sql(),
        "op6_minhash_dedup": minhash_sql(),
        "op7_chat_format": chat_format_sql(),
    }
