"""Queries of whole searches: phrases, the legs of a local search, and the search with rescues and reserved places."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import STOPWORDS
from ..operators import orchestration as O
from ..operators import vectors
from ..tables import table as T


def _chunks(spark, d):
    """Turns as chunks, conversations as sessions."""
    return T(spark, d, "conversations").select(
        (F.col("conv_id") * 10_000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session"), F.col("turn").alias("place"), F.col("role").alias("surface"), "text"
    )


def _asked(chunks):
    """The questions of every fiftieth conversation, which look for other conversations."""
    return chunks.filter("surface = 'user' and session % 50 = 0").select(F.col("id").alias("query"), F.col("session").alias("own"), "text")


def _phrases(spark, d):
    found = _chunks(spark, d).filter("surface = 'user'").select("id", F.posexplode(O.phrases(F.col("text"))).alias("no", "phrase"))
    return found.select("id", "no", "phrase")


def _local(spark, d):
    chunks = _chunks(spark, d)
    return O.local_search(chunks, _asked(chunks), 10, F.col("place"))


def _search(spark, d):
    """The vector of a conversation is that of its id, and stands for its first answer."""
    chunks = _chunks(spark, d)
    asked, v = _asked(chunks), T(spark, d, "embeddings")
    own = v.join(asked.select(F.col("own").alias("vec_id")).distinct(), "vec_id", "left_semi")
    near = vectors.exact(own, v, "vec_id", "embedding", 20)
    dense = asked.join(near.withColumnRenamed("query", "own"), "own").select("query", (F.col("vec_id") * 10_000 + 1).alias("id"), F.col("place").alias("position"))
    return O.search(chunks, asked, dense, 10)


_LEXEMES = "list_filter(list_transform(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9_./#-]*'), lambda t: rtrim(t, '.')), lambda t: t != '')"
_JOINED = f"array_to_string({_LEXEMES}, ' ')"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_ERRORS = ", ".join(f"'{w}'" for w in O.ERROR_WORDS)
_RUNS = " UNION ALL ".join(
    f"SELECT id, {w} AS part, i, array_to_string(words[i:i + {w - 1}], ' ') AS said FROM (SELECT id, words, unnest(range(1, greatest(len(words) - {w}, -1) + 2)) AS i FROM wd) WHERE regexp_matches(array_to_string(words[i:i + {w - 1}], ' '), '[^A-Za-z0-9_./# -]')"
    for w in range(O.PHRASE_WORDS[0], O.PHRASE_WORDS[1] + 1)
)
#: phrase rows of `asking` (id, text): id, no from 0, phrase.
_PHRASES = f"""
wd AS (SELECT id, regexp_extract_all(text, '\\S+') AS words FROM asking),
er AS (SELECT id, i, words FROM (SELECT id, words, unnest(range(1, len(words) + 1)) AS i FROM wd) WHERE regexp_replace(lower(words[i]), '[^a-z0-9_]', '', 'g') IN ({_ERRORS})),
pa AS (
  SELECT id, 0 AS part, 0 AS i, text AS said FROM asking
  UNION ALL SELECT id, 1, generate_subscripts(x, 1), unnest(x) FROM (SELECT id, regexp_extract_all(text, '["'']([^"'']+)["'']', 1) AS x FROM asking)
  UNION ALL {_RUNS}
  UNION ALL SELECT id, 20, 2 * i, array_to_string(words[i:i + 5], ' ') FROM er WHERE len(words[i:i + 5]) >= 3
  UNION ALL SELECT id, 20, 2 * i + 1, array_to_string(words[greatest(i - 2, 1):i], ' ') FROM er WHERE i >= 3),
pj AS (SELECT id, part, i, {_JOINED.format('said')} AS phrase FROM pa),
ph AS (SELECT id, CAST(no AS INT) AS no, phrase FROM (SELECT id, phrase, row_number() OVER (PARTITION BY id ORDER BY part, i) - 1 AS no
  FROM (SELECT id, phrase, min((part, i)).part AS part, min((part, i)).i AS i FROM (SELECT id, phrase, struct_pack(part := part, i := i) AS pi, part, i FROM pj WHERE phrase != '') GROUP BY id, phrase)) WHERE no < {O.MOST_PHRASES})
""".replace("min((part, i)).part", "min(pi).part").replace("min((part, i)).i", "min(pi).i")
_CHUNKS = f"ch AS (SELECT conv_id * 10000 + turn AS id, conv_id AS session, turn AS place, role AS surface, text, {_LEXEMES.format('text')} AS w FROM conversations)"
_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_NAMES = "(regexp_matches({0}, '[0-9]') AND regexp_matches({0}, '[-_./#]') OR regexp_full_match({0}, '[0-9a-f]{{8,}}'))"
_BASE = f"""
{_CHUNKS},
q AS (SELECT id AS query, session AS own, text FROM ch WHERE surface = 'user' AND session % 50 = 0),
asking AS (SELECT query AS id, text FROM q), {_PHRASES},
a AS (SELECT query, own, term, min(i) AS i FROM (SELECT query, own, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM q JOIN ch ON ch.id = q.query)
  WHERE (length(term) > 2 OR regexp_matches(term, '[0-9]')) AND term NOT IN ({_STOP}) GROUP BY ALL),
p AS (SELECT id, session, surface, length, term, count(*) AS tf FROM (SELECT id, session, surface, len(w) AS length, unnest(w) AS term FROM ch) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM ch),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
m AS (SELECT query, id, session, surface, term, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS part FROM a JOIN p USING (term) JOIN f USING (term), st WHERE session != own),
s AS (SELECT query, id, session, surface, round(sum(part), 8) AS bm, CAST(count(*) AS INT) AS n_matched, CAST(count(*) FILTER (WHERE length(term) >= 5) AS INT) AS n_long FROM m GROUP BY ALL),
nt AS (SELECT query, CAST(count(*) AS INT) AS n_terms FROM a GROUP BY 1),
ids AS (SELECT query, own, term, row_number() OVER (PARTITION BY query ORDER BY regexp_full_match(term, '{_UUID}') DESC, regexp_full_match(term, '[0-9a-f]{{8,}}') DESC, length(term) DESC, term DESC) - 1 AS no FROM a WHERE {_NAMES.format('term')}),
in_phrase AS (SELECT DISTINCT query, no, ch.id FROM ph JOIN q ON q.query = ph.id JOIN ch ON ch.session != q.own AND contains(' ' || array_to_string(w, ' ') || ' ', ' ' || phrase || ' ')
  WHERE EXISTS (SELECT 1 FROM a WHERE a.query = q.query AND contains(' ' || phrase || ' ', ' ' || a.term || ' '))),
has_name AS (SELECT DISTINCT ids.query, no, m.id FROM ids JOIN m ON m.query = ids.query AND m.term = ids.term)
"""
_TOP = "row_number() OVER (PARTITION BY {by} ORDER BY bm DESC, id)"
_LOCAL = f"""
WITH {_BASE},
own_names AS (SELECT DISTINCT ids.query, p.id FROM ids JOIN p ON p.session != ids.own AND (p.term = ids.term OR regexp_full_match(ids.term, '[0-9a-f]{{8,}}') AND starts_with(p.term, ids.term)) WHERE {_NAMES.format('p.term')} AND (length(p.term) > 2 OR regexp_matches(p.term, '[0-9]')) AND p.term NOT IN ({_STOP})),
la AS (SELECT query, id, bm, n_long, 'A' AS leg FROM in_phrase JOIN s USING (query, id) QUALIFY {_TOP.format(by='query, no')} <= 400),
lb AS (SELECT query, id, 25.0 AS bm, coalesce(n_long, 0) AS n_long, 'B' AS leg FROM own_names LEFT JOIN s USING (query, id) QUALIFY row_number() OVER (PARTITION BY query ORDER BY coalesce(s.bm, 0) DESC, id) <= 400),
li AS (SELECT query, id, bm, n_long, 'I' AS leg FROM has_name JOIN s USING (query, id) QUALIFY {_TOP.format(by='query, no')} <= 100),
lc AS (SELECT query, id, bm, n_long, 'C' AS leg FROM s JOIN nt USING (query) WHERE n_matched = n_terms QUALIFY {_TOP.format(by='query')} <= 400),
precise AS (SELECT * FROM la UNION ALL SELECT * FROM lb UNION ALL SELECT * FROM li UNION ALL SELECT * FROM lc),
n AS (SELECT query, (SELECT count(DISTINCT id) FROM precise WHERE precise.query = nt.query) AS n_precise FROM nt),
ld AS (SELECT query, id, bm, n_long, 'D' AS leg FROM s JOIN n USING (query) WHERE n_precise < 30 QUALIFY {_TOP.format(by='query')} <= 400),
b AS (SELECT query, id, max(bm) AS bm, max(n_long) AS n_long, list_sort(list(DISTINCT leg)) AS legs FROM (SELECT * FROM precise UNION ALL SELECT * FROM ld) GROUP BY ALL),
c AS (SELECT b.*, session, list_has_any(legs, ['A', 'B', 'I']) AS exact, CASE WHEN list_has_any(legs, ['A', 'B', 'I']) THEN 2 WHEN list_contains(legs, 'C') THEN 1 ELSE 0 END AS tier,
  round((greatest(0.01, 1 + bm) * CASE surface WHEN 'user' THEN 4.0 WHEN 'assistant' THEN 2.0 WHEN 'tool_input' THEN 1.5 ELSE 1.0 END + CASE WHEN list_has_any(legs, ['A', 'B', 'I']) THEN 10 ELSE 0 END) / (1 + place / 180), 6) AS score FROM b JOIN ch USING (id)),
t AS (SELECT *, count(*) OVER (PARTITION BY query, session) AS n_chunks FROM c QUALIFY row_number() OVER (PARTITION BY query, session ORDER BY tier DESC, score DESC, id) = 1),
k AS (SELECT query, session, id, CAST(tier AS INT) AS tier, round(score + 0.2 * ln(1 + n_chunks), 6) AS score, array_to_string(legs, ',') AS legs, n_chunks FROM t WHERE tier > 0 OR n_long >= 2)
SELECT k.*, CAST(row_number() OVER (PARTITION BY query ORDER BY tier DESC, score DESC, session) AS INT) AS place, n_precise, n_precise < 30 AS ran_any FROM k JOIN n USING (query) QUALIFY place <= 10
"""
_CLASS = "CASE leg WHEN 'identifier' THEN 4 WHEN 'answer' THEN 3 WHEN 'exact-question' THEN 3 WHEN 'phrase' THEN 3 WHEN 'semantic' THEN 2 WHEN 'pair' THEN 1 WHEN 'anchor' THEN 1 ELSE 0 END"
_KEY = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
_COLS = "query, id, leg, position, bm, n_matched, n_long"
_SEARCH = f"""
WITH {_BASE},
base AS (SELECT query, n_terms, EXISTS (SELECT 1 FROM ids WHERE ids.query = nt.query) AS has_identifier FROM nt),
eq AS (SELECT q.query, min(ch.id) AS id FROM q JOIN base USING (query) JOIN ch ON ch.surface = 'user' AND ch.session != q.own AND {_KEY.format('ch.text')} = {_KEY.format('q.text')} GROUP BY q.query, ch.session),
l1 AS (SELECT query, id, 'exact-question' AS leg, {_TOP.format(by='query')} AS position, bm, n_matched, n_long FROM eq JOIN s USING (query, id) QUALIFY position <= 100),
l2 AS (SELECT query, id, 'identifier' AS leg, {_TOP.format(by='query, no')} AS position, bm, n_matched, n_long FROM has_name JOIN s USING (query, id) WHERE no < 3 QUALIFY position <= 100 AND no = min(no) OVER (PARTITION BY query)),
v AS (SELECT x.vec_id AS own, y.vec_id AS session, row_number() OVER (PARTITION BY x.vec_id ORDER BY round(1 - list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6), y.vec_id) AS position FROM embeddings x, embeddings y WHERE x.vec_id IN (SELECT own FROM q) QUALIFY position <= 20),
l3 AS (SELECT query, ch.id, 'semantic' AS leg, position, coalesce(bm, 0) AS bm, coalesce(n_matched, 0) AS n_matched, coalesce(n_long, 0) AS n_long FROM q JOIN base USING (query) JOIN v USING (own) JOIN ch ON ch.id = v.session * 10000 + 1 LEFT JOIN s ON s.query = q.query AND s.id = ch.id WHERE NOT has_identifier AND v.session != q.own),
r1 AS (SELECT {_COLS} FROM l1 UNION ALL SELECT {_COLS} FROM l2 UNION ALL SELECT {_COLS} FROM l3),
f1 AS (SELECT base.*, (SELECT count(*) FROM l1 WHERE l1.query = base.query) AS n_exact, (SELECT count(DISTINCT r1.id) FROM r1 WHERE r1.query = base.query) AS n_found, (SELECT count(DISTINCT r1.id // 10000) FROM r1 WHERE r1.query = base.query) AS n_sessions FROM base),
g1 AS (SELECT query, n_terms, has_identifier, n_exact, NOT has_identifier AND n_exact = 0 AND (n_sessions < 9 AND n_terms >= 2 OR n_found < 10 AND n_terms = 1) AS ran_phrase FROM f1),
l4 AS (SELECT query, id, 'phrase' AS leg, {_TOP.format(by='query, no')} AS position, bm, n_matched, n_long FROM in_phrase JOIN s USING (query, id) JOIN g1 USING (query) WHERE ran_phrase QUALIFY position <= 100),
r2 AS (SELECT * FROM r1 UNION ALL SELECT {_COLS} FROM l4),
g2 AS (SELECT *, NOT has_identifier AND (SELECT count(DISTINCT r2.id) FROM r2 WHERE r2.query = g1.query) < 10 AS ran_partial FROM g1),
ranked AS (SELECT query, term, i, row_number() OVER (PARTITION BY query ORDER BY regexp_matches(term, '[._/-]') DESC, regexp_matches(term, '[0-9]') DESC, length(term) DESC, i) AS r, regexp_matches(term, '[._/-]') AS joined FROM a),
pr AS (SELECT query, 'pair' AS kind, term FROM ranked JOIN nt USING (query) WHERE r <= 2 AND n_terms >= 2 UNION ALL SELECT query, 'anchor', term FROM ranked WHERE joined QUALIFY row_number() OVER (PARTITION BY query ORDER BY length(term) DESC, i) = 1),
pm AS (SELECT query, kind, m.id FROM pr JOIN g2 USING (query) JOIN m USING (query, term) WHERE ran_partial GROUP BY query, kind, m.id HAVING count(*) = CASE kind WHEN 'pair' THEN 2 ELSE 1 END),
l5 AS (SELECT query, id, kind AS leg, {_TOP.format(by='query, kind')} AS position, bm, n_matched, n_long FROM pm JOIN s USING (query, id) QUALIFY position <= 100),
r3 AS (SELECT * FROM r2 UNION ALL SELECT {_COLS} FROM l5),
g3 AS (SELECT *, (SELECT count(DISTINCT r3.id) FROM r3 WHERE r3.query = g2.query) < 10 AND coalesce((SELECT max({_CLASS}) FROM r3 WHERE r3.query = g2.query), 0) < 3 AS ran_all FROM g2),
l6 AS (SELECT query, id, 'all' AS leg, {_TOP.format(by='query')} AS position, bm, n_matched, n_long FROM s JOIN g3 USING (query) WHERE ran_all AND n_matched = n_terms QUALIFY position <= 100),
r4 AS (SELECT * FROM r3 UNION ALL SELECT {_COLS} FROM l6),
nx AS (SELECT id, surface, first_value(CASE WHEN surface = 'assistant' THEN id END IGNORE NULLS) OVER (PARTITION BY session ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS answer FROM ch),
an AS (SELECT query, answer AS id, max(bm) AS bm FROM r4 JOIN nx USING (id) WHERE surface = 'user' AND answer IS NOT NULL GROUP BY ALL),
l7 AS (SELECT query, id, 'answer' AS leg, {_TOP.format(by='query')} AS position, bm, 0 AS n_matched, 2 AS n_long FROM an QUALIFY position <= 100),
pt AS (SELECT query, id, leg, max(1 / (60 + position)) AS part, max(n_matched) AS n_matched, max(n_long) AS n_long FROM (SELECT * FROM r4 UNION ALL SELECT {_COLS} FROM l7) GROUP BY ALL),
c AS (SELECT query, id, id // 10000 AS session, max({_CLASS}) AS class, round(sum(part), 8) AS fusion, max(n_matched) AS n_matched, max(n_long) AS n_long, string_agg(leg, ',' ORDER BY leg) AS legs FROM pt GROUP BY ALL HAVING max({_CLASS}) > 0 OR max(n_long) >= 2),
g AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query, session ORDER BY class DESC, n_matched DESC, fusion DESC, id) = 1),
ac AS (SELECT query, id // 10000 AS session, row_number() OVER (PARTITION BY query ORDER BY min(position), id // 10000) AS anchor FROM r4 WHERE leg = 'semantic' GROUP BY query, id // 10000),
rc AS (SELECT query, id // 10000 AS session, row_number() OVER (PARTITION BY query ORDER BY max(bm) DESC, id // 10000) AS rescue FROM r4 WHERE leg = 'phrase' GROUP BY query, id // 10000),
x AS (SELECT g.*, coalesce(anchor <= 9, false) AS kept, rescue, max(CASE WHEN anchor IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY query) AS has_anchor FROM g LEFT JOIN ac USING (query, session) LEFT JOIN rc USING (query, session)),
y AS (SELECT *, CASE WHEN kept THEN 'anchor' WHEN has_anchor = 1 AND rescue = min(CASE WHEN NOT kept THEN rescue END) OVER (PARTITION BY query) THEN 'rescue' ELSE 'rank' END AS slot FROM x),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY query ORDER BY CASE slot WHEN 'anchor' THEN 0 WHEN 'rescue' THEN 1 ELSE 2 END, class DESC, n_matched DESC, fusion DESC, id) <= 10)
SELECT query, session, id, CAST(class AS INT) AS class, n_matched, fusion, legs, slot, CAST(row_number() OVER (PARTITION BY query ORDER BY class DESC, n_matched DESC, fusion DESC, id) AS INT) AS place, has_identifier, n_exact, ran_phrase, ran_partial, ran_all FROM z JOIN g3 USING (query)
"""

QUERIES = {
    "str09_phrases": (_phrases, f"WITH {_CHUNKS}, asking AS (SELECT id, text FROM ch WHERE surface = 'user'), {_PHRASES} SELECT id, no, phrase FROM ph"),
    "top02_local_search": (_local, _LOCAL),
    "top15_search": (_search, _SEARCH),
}
