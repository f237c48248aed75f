"""SQL twins of the pN_ queries, over whole tables, where SQL can say the same.

They take plainer ways than the operators (prefix-filtered joins of words, ten-word
and 200-character windows, recursive reachability) and so check them independently.
No twin: p1_splits (a hash decides among equal choices), p3 (learned from the data),
p8_ids (byte-pair encoding); the tests check those."""

from tarnloom.llm.norm import _FROM, _TO
from tarnloom.plans.registry import SOURCE_SQL, SPLIT_SQL, vid_sql


def _q(s: str) -> str:
    return s.replace("'", "''")


_DISPLAY = f"CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN nfc_normalize(translate(nfc_normalize(text), '{_q(_FROM)}', '{_q(_TO)}')) ELSE text END"
_WORDS = r"list_filter(string_split_regex(regexp_replace(lower({c}), '[''’]', '', 'g'), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_SQUEEZE = r"regexp_replace({c}, '[^\p{L}\p{N}]+', '', 'g')"


def _words(c: str) -> str:
    return _WORDS.replace("{c}", c)


def _squeeze(c: str) -> str:
    return _SQUEEZE.replace("{c}", c)


_FIELDS = r"list_filter(string_split_regex(lower(shown), '[|;]'), lambda p: regexp_matches(p, '[\p{L}\p{N}]'))"
_PAIR = _squeeze("string_split(p, ':')[1]") + " || ':' || " + _squeeze("regexp_replace(p, '^[^:]*:', '')")
#: caption rows of six or more words with display form, words and content key
CAPTIONS = rf"""shown AS (SELECT pos, text, {_DISPLAY} AS shown FROM manifest WHERE text IS NOT NULL AND pos IS NOT NULL),
  worded AS (SELECT pos, text, shown, {_words('shown')} AS words, {_FIELDS} AS fields FROM shown),
  captions AS (SELECT pos, text, shown, words, CASE WHEN regexp_matches(shown, '[|;]') AND len(fields) >= 2
      AND len(list_filter(fields, lambda p: regexp_matches(p, '^[^:]*[\p{{L}}\p{{N}}][^:]*:(?s:.)*[\p{{L}}\p{{N}}]'))) = len(fields)
    THEN array_to_string(list_sort(list_transform(fields, lambda p: {_PAIR})), '|') ELSE {_squeeze('lower(shown)')} END AS ckey FROM worded WHERE len(words) >= 6)"""

# similarity join: a shared word among the rarest third, then the whole overlap
NEAR = """occ AS (SELECT pos, word, count(*) AS k FROM (SELECT pos, unnest(words) AS word FROM captions) GROUP BY ALL),
  sized AS (SELECT pos, len(words) AS n FROM captions),
  freq AS (SELECT word, count(*) AS df FROM occ GROUP BY 1),
  prefix AS (SELECT pos, word FROM (SELECT o.pos, o.word, coalesce(sum(k) OVER (PARTITION BY o.pos ORDER BY df, o.word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, n
    FROM occ o JOIN freq USING (word) JOIN sized USING (pos)) WHERE before < n // 3 + 1),
  cand AS (SELECT DISTINCT a.pos AS x, b.pos AS y FROM prefix a JOIN prefix b ON a.word = b.word AND a.pos < b.pos JOIN sized s ON s.pos = a.pos JOIN sized t ON t.pos = b.pos WHERE 3 * s.n >= 2 * t.n AND 3 * t.n >= 2 * s.n),
  shared AS (SELECT x, y, sum(least(a.k, b.k)) AS o FROM cand JOIN occ a ON a.pos = x JOIN occ b ON b.pos = y AND b.word = a.word GROUP BY ALL),
  near AS (SELECT x, y FROM shared JOIN sized s ON s.pos = x JOIN sized t ON t.pos = y WHERE 5 * o >= 2 * (s.n + t.n))"""

_JOBS = f"jobs AS (SELECT {vid_sql()} AS v, min({SPLIT_SQL}) AS js FROM clip_jobs WHERE {SPLIT_SQL} IS NOT NULL GROUP BY 1)"
_SIDES = f"{_JOBS}, sides AS (SELECT pos, coalesce({SPLIT_SQL}, js) AS split FROM manifest LEFT JOIN jobs ON jobs.v = {vid_sql('manifest.vid')} WHERE coalesce({SPLIT_SQL}, js) IS NOT NULL)"
_CROSS = f"""WITH {CAPTIONS}, {NEAR}, {_SIDES},
  alike AS (SELECT x, y, false AS exact FROM near JOIN captions a ON a.pos = x JOIN captions b ON b.pos = y WHERE a.ckey <> b.ckey
    UNION ALL SELECT a.pos, b.pos, true FROM captions a JOIN captions b ON a.ckey = b.ckey AND a.pos < b.pos),
  crossed AS (SELECT x, y, exact, s.split AS sx, t.split AS sy FROM alike JOIN sides s ON s.pos = x JOIN sides t ON t.pos = y WHERE (s.split = 'train') <> (t.split = 'train'))"""

_PLAIN = r"trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))"
_SPLIT = f"d AS (SELECT doc_id, string_split({_PLAIN}, ' ') AS w FROM documents WHERE text <> ''), i AS (SELECT item_id, string_split({_PLAIN}, ' ') AS w FROM eval_items WHERE text <> '')"
_TEN = f"""{_SPLIT},
  dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) AS g FROM d WHERE len(w) >= 10),
  ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) AS g FROM i WHERE len(w) >= 10)"""

_SPANS = """g AS (SELECT doc_id, k, substring(text, k, 200) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS k FROM documents WHERE length(text) >= 200)),
  many AS (SELECT s FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)), hit AS (SELECT g.doc_id, g.k, g.s FROM g JOIN many ON many.s = g.s)"""

_LINKS = f"""ids AS (SELECT DISTINCT {vid_sql()} AS v FROM manifest), p AS (SELECT {vid_sql('vid_a')} AS a, {vid_sql('vid_b')} AS b FROM match_pairs WHERE score >= 90 AND score::VARCHAR <> 'nan'),
  e AS (SELECT a, b FROM p WHERE a <> b AND a IN (SELECT v FROM ids) AND b IN (SELECT v FROM ids)), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  r AS (SELECT a AS node, a AS seen FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.seen)"""

ORACLE: dict[str, str] = {
    "p1_found": f"SELECT substring(trim(vid), 1, 11) AS recording FROM manifest WHERE length(trim(vid)) >= 11 GROUP BY 1 HAVING count(DISTINCT {SPLIT_SQL}) >= 2",
    "p2_found": f"WITH {CAPTIONS} SELECT first_pos, pos AS copy_pos FROM (SELECT pos, min(pos) OVER (PARTITION BY ckey) AS first_pos FROM captions) WHERE pos <> first_pos",
    "p2_collapsed": f"WITH {CAPTIONS} SELECT min(pos) AS first_pos, count(*) AS n, arg_min(text, pos) AS text FROM captions GROUP BY ckey",
    "p4_found": f"WITH {CAPTIONS}, {NEAR} SELECT x AS pos_a, y AS pos_b FROM near JOIN captions a ON a.pos = x JOIN captions b ON b.pos = y WHERE a.ckey <> b.ckey",
    "p5_found": f"{_CROSS} SELECT x AS pos_a, y AS pos_b FROM crossed",
    "p5_counts": f"""{_CROSS}, one AS (SELECT CASE WHEN sx = 'train' THEN y ELSE x END AS pos, CASE WHEN sx = 'train' THEN sy ELSE sx END AS split, exact FROM crossed)
      SELECT one.split, {SOURCE_SQL} AS source, count(DISTINCT pos) AS eval_rows, count(*) FILTER (WHERE exact) AS same_pairs, count(*) FILTER (WHERE NOT exact) AS near_pairs
      FROM one JOIN manifest USING (pos) GROUP BY 1, 2""",
    "p6_found": f"WITH {CAPTIONS} SELECT a.pos AS pos_a, b.pos AS pos_b FROM captions a JOIN captions b ON a.shown = b.shown AND a.text <> b.text AND a.pos < b.pos",
    "p6_canonical": f"SELECT pos, text, {_DISPLAY} AS canonical FROM manifest",
    "p7_found": f"WITH RECURSIVE {_LINKS} SELECT min(seen) AS group_vid, node AS vid FROM r GROUP BY node",
    "p9_found": f"WITH {_TEN} SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)",
    "p9_leaked": f"""WITH {_SPLIT},
      dk AS (SELECT doc_id, k, array_to_string(w[k:k + 9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS k FROM d WHERE len(w) >= 10)),
      ik AS (SELECT item_id, j, array_to_string(w[j:j + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS j FROM i WHERE len(w) >= 10)),
      runs AS (SELECT doc_id, item_id, k - j AS diagonal, k - row_number() OVER (PARTITION BY doc_id, item_id, k - j ORDER BY k) AS run FROM dk JOIN ik USING (g)),
      most AS (SELECT doc_id, item_id, 9 + max(n) AS words FROM (SELECT doc_id, item_id, diagonal, run, count(*) AS n FROM runs GROUP BY ALL) GROUP BY ALL)
      SELECT item_id, count(*) AS documents, max(words)::INT AS most_words FROM most GROUP BY item_id""",
    "p10_found": f"WITH {_SPANS} SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM hit a JOIN hit b ON a.s = b.s AND a.doc_id < b.doc_id",
    "p10_coverage": f"""WITH {_SPANS}, c AS (SELECT doc_id, k, k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS step FROM hit),
      t AS (SELECT doc_id, sum(CASE WHEN step IS NULL THEN 200 ELSE least(step, 200) END)::BIGINT AS shared_chars FROM c GROUP BY 1)
      SELECT doc_id, length(text) AS chars, shared_chars, round(shared_chars / length(text), 4) AS share FROM t JOIN documents USING (doc_id)""",
}
