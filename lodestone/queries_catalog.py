"""Further queries: the composed search and its modes, the text index as tables, audits and queue transitions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lodestone.functions import fields
from lodestone.functions import predicates as P
from lodestone.functions import records as R
from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import audit, batching, catalog, jobs, knn, search, segments, textindex
from lodestone.plans.decompose import Plan
from lodestone.queries import _ANY_SCRIPT, _COS, _JOBS, _R6, _SCORE, _axes, _files, _index, _jobs, _now, _t, _texts, _vector, _vectors, query
from lodestone.sources.shared import shared_path
from lodestone.streaming import monitor, sessions

# ------------------------------------------------------------------ search

_HALF = "list_cosine_similarity(list_slice(embedding::DOUBLE[], 1, 32), (SELECT list_slice(embedding::DOUBLE[], 1, 32) FROM embeddings WHERE vec_id = {}))"


def _corpus(s, d):
    v = _vectors(s, d).select("id", "embedding")
    files = _files(s, d).select("id", F.col("text").alias("mc_caption"), F.col("lang").alias("image_type"), F.col("source").alias("folder_path"), F.concat(F.lit("top/"), "source").alias("file_path"), F.array("lang", "source").alias("ai_tags"), F.col("n_chars").alias("parsed_at"))
    axes = {"V": v, "S": v.withColumn("embedding", V.truncate(F.col("embedding"), 32)), "X": v.withColumn("embedding", V.fit_to(F.col("embedding"), 96))}
    return search.Corpus(files, axes)


def _searched(s, d):
    """The corpus with its stored index of words."""
    return replace(_corpus(s, d), text=_index(s, d))


def _queries(s, d):
    first = _vector(s, d, 0)
    return {"V": first, "S": _vector(s, d, 3)[:32]}


_TRIAXIS = f"""{_ANY_SCRIPT}, hits AS (SELECT * FROM post WHERE token IN ('thand', 'src3') AND id NOT IN (SELECT id FROM post WHERE token = 'idiot')), {_SCORE},
hits1 AS (SELECT id, 1.0 AS wt, token FROM post WHERE token IN ('thand', 'src3')), tf1 AS (SELECT id, token, sum(wt) AS tf FROM hits1 GROUP BY ALL), df1 AS (SELECT token, count(*) AS df FROM tf1 GROUP BY token),
scores1 AS (SELECT id, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS score FROM tf1 JOIN df1 USING (token) JOIN dl USING (id), tot GROUP BY id),
e AS (SELECT vec_id AS id, {_COS.format(0)} AS vsc, {_HALF.format(3)} AS ssc, {_COS.format(5)} AS neg FROM embeddings),
v AS (SELECT id, vsc AS score FROM e WHERE vsc >= 0 ORDER BY vsc DESC, id LIMIT 50), t AS (SELECT id, ssc AS score FROM e WHERE ssc >= 0 ORDER BY ssc DESC, id LIMIT 50),
m0 AS (SELECT id, score FROM scores ORDER BY score DESC, id LIMIT 50),
m AS (SELECT id, CASE WHEN max(score) OVER () - min(score) OVER () <= 1e-12 THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS score FROM m0),
r AS (SELECT 'V' AS axis, 0.2 AS w, id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM v UNION ALL SELECT 'S', 0.5, id, score, row_number() OVER (ORDER BY score DESC, id) - 1 FROM t UNION ALL SELECT 'M', 0.3, id, score, row_number() OVER (ORDER BY score DESC, id) - 1 FROM m),
f AS (SELECT id, sum(w / (61 + rank)) AS rrf, max(score) FILTER (axis = 'V') AS vs, max(score) FILTER (axis = 'S') AS ss, max(score) FILTER (axis = 'M') AS ms FROM r GROUP BY id),
g AS (SELECT f.*, e.vsc, e.ssc, e.neg, d.text, d.lang, d.source FROM f JOIN documents d ON d.doc_id = f.id LEFT JOIN e ON e.id = f.id),
h AS (SELECT *, contains(lower(concat_ws(' ', text, lang, source)), 'idiot')::INT + CASE WHEN count(neg) OVER () >= 3 AND neg > avg(neg) OVER () + stddev_pop(neg) OVER () THEN 0.6 ELSE 0 END AS ns FROM g),
i AS (SELECT *, row_number() OVER (ORDER BY ns > 0.45, CASE WHEN ns > 0.45 THEN -ns ELSE 0 END, rrf DESC, id) - 1 AS idx FROM h WHERE lang IN ('en', '') AND starts_with(source, 'src')),
p0 AS (SELECT * FROM i WHERE idx < 80),
ph AS (SELECT id, CASE WHEN max(score) OVER () - min(score) OVER () <= 1e-12 THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS score FROM scores1 WHERE id IN (SELECT id FROM p0)),
p AS (SELECT p0.*, coalesce(vs, vsc) AS v1, coalesce(ss, ssc) AS s1, coalesce(ms, ph.score) AS m1, CASE WHEN count(*) OVER () > 1 THEN 1.0 - idx / (count(*) OVER () - 1) ELSE 1.0 END AS prior FROM p0 LEFT JOIN ph USING (id)),
n AS (SELECT *, CASE WHEN v1 IS NULL THEN NULL WHEN max(v1) OVER () - min(v1) OVER () <= 1e-12 THEN 1 ELSE (v1 - min(v1) OVER ()) / (max(v1) OVER () - min(v1) OVER ()) END AS nv, CASE WHEN s1 IS NULL THEN NULL WHEN max(s1) OVER () - min(s1) OVER () <= 1e-12 THEN 1 ELSE (s1 - min(s1) OVER ()) / (max(s1) OVER () - min(s1) OVER ()) END AS nsem, CASE WHEN m1 IS NULL THEN NULL WHEN max(m1) OVER () - min(m1) OVER () <= 1e-12 THEN 1 ELSE (m1 - min(m1) OVER ()) / (max(m1) OVER () - min(m1) OVER ()) END AS nm FROM p),
q AS (SELECT *, coalesce(0.2 * nv, 0) + coalesce(0.5 * nsem, 0) + coalesce(0.3 * nm, 0) AS num, CASE WHEN nv IS NULL THEN 0 ELSE 0.2 END + CASE WHEN nsem IS NULL THEN 0 ELSE 0.5 END + CASE WHEN nm IS NULL THEN 0 ELSE 0.3 END AS den FROM n),
z AS (SELECT *, 0.62 * CASE WHEN den > 0 THEN num / den ELSE prior END + 0.23 * prior + 0.10 * (CASE WHEN trim(text) <> '' THEN 0.35 ELSE 0 END + 0.25 + CASE WHEN lang <> '' THEN 0.3 ELSE 0 END)
 + 0.05 * (0.55 * contains(lower(concat_ws(' ', source, 'top/' || source, text, lang, lang, source)), 'thand')::INT + 0.25 * (lang = 'en')::INT / 2.0 + 0.20 * CASE WHEN ends_with('top/' || source, 'p/src3') THEN 1.0 WHEN contains('top/' || source, 'p/src3') THEN 0.8 ELSE 0 END) AS quality FROM q)
SELECT id, round(rrf, 6) AS rrf, round(quality, 6) AS quality, demoted, round(v1, 6) AS vector_score, row_number() OVER (ORDER BY round(quality, 9) DESC, rrf DESC, idx) AS place FROM (SELECT *, ns > 0.45 AS demoted FROM z) ORDER BY place LIMIT 10"""


@query(f"WITH {_TRIAXIS}")
def r20_search(s, d):
    plan = Plan("p/src3", "semantic", keywords=["thand", "src3"], excluded=["idiot"], negative="idiot", filters={"image_type": "en"})
    got = search.composed(_searched(s, d), _queries(s, d), plan, 10, {"folder_path": "src"}, _vector(s, d, 5), ["thand"])
    return got.select("id", _R6("rrf"), _R6("quality"), "demoted", F.round("V_score", 6).alias("vector_score"), F.col("place").cast("long").alias("place"))


def _four_axes(sql: str) -> str:
    """The search of three axes with structure as the fourth, which borrows its weight from the visual one."""
    norm = sql[sql.index("CASE WHEN v1 IS NULL") : sql.index(" AS nv,") + 7]
    for old, new in (
        (" AS neg FROM", f" AS neg, {_COS.format(6)} AS xsc FROM"),
        ("m0 AS (SELECT", "x AS (SELECT id, xsc AS score FROM e WHERE xsc >= 0 ORDER BY xsc DESC, id LIMIT 50),\nm0 AS (SELECT"),
        ("0.2 AS w", "0.13 AS w"),
        ("row_number() OVER (ORDER BY score DESC, id) - 1 FROM m)", "row_number() OVER (ORDER BY score DESC, id) - 1 FROM m UNION ALL SELECT 'X', 0.07, id, score, row_number() OVER (ORDER BY score DESC, id) - 1 FROM x)"),
        (" AS ms FROM r", " AS ms, max(score) FILTER (axis = 'X') AS xs FROM r"),
        ("e.neg,", "e.neg, e.xsc,"),
        (" AS m1,", " AS m1, coalesce(xs, xsc) AS x1,"),
        (norm, norm + " " + norm.replace("v1", "x1").replace("nv", "nx")),
        ("coalesce(0.2 * nv, 0)", "coalesce(0.13 * nv, 0) + coalesce(0.07 * nx, 0)"),
        ("CASE WHEN nv IS NULL THEN 0 ELSE 0.2 END", "CASE WHEN nv IS NULL THEN 0 ELSE 0.13 END + CASE WHEN nx IS NULL THEN 0 ELSE 0.07 END"),
    ):
        assert old in sql, old
        sql = sql.replace(old, new)
    return sql


@query(_four_axes(f"WITH {_TRIAXIS}"))
def r21_four_axes(s, d):
    """An image and a text: all four axes, the visual one from the image."""
    plan = Plan("p/src3", "semantic", keywords=["thand", "src3"], excluded=["idiot"], negative="idiot", filters={"image_type": "en"})
    axes = {"S": _vector(s, d, 3)[:32], "X": [*_vector(s, d, 6), *[0.0] * 32]}
    got = search.search("image_text", _searched(s, d), axes, plan, 10, vectors=[_vector(s, d, 0)], user_filters={"folder_path": "src"}, negative=_vector(s, d, 5), tokens=["thand"])
    return got.select("id", _R6("rrf"), _R6("quality"), "demoted", F.round("V_score", 6).alias("vector_score"), F.col("place").cast("long").alias("place"))


@query(f"SELECT vec_id AS id, round({_HALF.format(3)}, 6) AS similarity FROM embeddings WHERE {_HALF.format(3)} >= 0 ORDER BY {_HALF.format(3)} DESC, vec_id LIMIT 10")
def v3_j2_knn_meaning(s, d):
    return search.search("meaning", _corpus(s, d), _queries(s, d), top_k=10).select("id", _R6("similarity"))


@query(f"SELECT vec_id AS id, round({_COS.format(4)}, 6) AS similarity FROM embeddings WHERE {_COS.format(4)} >= 0.1 ORDER BY {_COS.format(4)} DESC, vec_id LIMIT 10")
def v4_j3_knn_structure(s, d):
    """The structure axis pads to a fixed length, which leaves similarities as they are."""
    return search.search("structure", _corpus(s, d), {"X": [*_vector(s, d, 4), *[0.0] * 32]}, top_k=10, threshold=0.1).select("id", _R6("similarity"))


@query(f"SELECT vec_id AS id, NULL::DOUBLE AS rrf, round({_COS.format(0)}, 6) AS combined_score, row_number() OVER (ORDER BY {_COS.format(0)} DESC, vec_id) AS idx FROM embeddings JOIN documents ON doc_id = vec_id WHERE {_COS.format(0)} >= 0 ORDER BY idx LIMIT 25")
def r7_single_axis(s, d):
    c = _corpus(s, d)
    rows, used = search.merged(search.candidates(search.Corpus(c.files, c.vectors), {"V": _vector(s, d, 0)}, Plan(""), 5), Plan(""))
    assert used is None
    place = F.row_number().over(search.Window.orderBy(F.desc("first"), "id"))
    return rows.select("id", "rrf", F.round("first", 6).alias("combined_score"), place.cast("long").alias("idx"))


@query(f"WITH x AS (SELECT vec_id AS id, {_COS.format(0)} AS vs FROM embeddings) SELECT id, round(vs, 6) AS combined_score, round(vs / 0.01639 * 100, 1) AS percent, 0.0 AS quality FROM x")
def r23_p24_shape(s, d):
    v = knn.scored(_vectors(s, d), _vector(s, d, 0), None)
    rows = v.select("id", F.lit(None).cast("double").alias("rrf"), F.col("similarity").alias("V_score"), *(F.lit(None).cast("double").alias(c) for c in ("S_score", "X_score", "M_score", "quality")), F.lit(1).alias("place"))
    return search.shape(rows).select("id", F.round("combined_score", 6).alias("combined_score"), "percent", "quality")


@query("SELECT doc_id AS id FROM documents WHERE starts_with(source, 'src1') AND lang = 'de' ORDER BY n_chars DESC, doc_id LIMIT 20")
def t8_p7_metadata_search(s, d):
    return search.search("metadata", _corpus(s, d), top_k=20, user_filters={"folder_path": "src1", "image_type": "DE"}).select("id")


@query(f"SELECT vec_id AS id, round({_COS.format(0)}, 6) AS similarity FROM embeddings JOIN documents ON doc_id = vec_id WHERE lang = 'fr' AND {_COS.format(0)} >= 0.02 ORDER BY {_COS.format(0)} DESC, vec_id LIMIT 10")
def r22_hybrid_mode(s, d):
    return search.search("hybrid", _corpus(s, d), _queries(s, d), top_k=10, user_filters={"image_type": "fr"}, threshold=0.02).select("id", _R6("similarity"))


@query(f"SELECT 'similar' AS mode, * FROM (SELECT vec_id AS id, round({_COS.format(3)}, 6) AS similarity FROM embeddings WHERE vec_id <> 3 AND {_COS.format(3)} >= 0 ORDER BY {_COS.format(3)} DESC, vec_id LIMIT 10) UNION ALL SELECT 'similar_structure', * FROM (SELECT vec_id, round({_COS.format(4)}, 6) FROM embeddings WHERE vec_id <> 4 AND {_COS.format(4)} >= 0.05 ORDER BY {_COS.format(4)} DESC, vec_id LIMIT 10)")
def r22_by_id_modes(s, d):
    c = _corpus(s, d)
    a = search.search("similar", c, top_k=10, id=3)
    b = search.search("similar_structure", c, top_k=10, id=4, threshold=0.05)
    parts = [x.select(F.lit(m).alias("mode"), "id", _R6("similarity")) for m, x in (("similar", a), ("similar_structure", b))]
    return parts[0].unionByName(parts[1])


@query("SELECT text, count(*) OVER (PARTITION BY text) AS n, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS place, doc_id AS id FROM documents WHERE text IS NOT NULL QUALIFY n > 1")
def a16_duplicate_members(s, d):
    return catalog.duplicate_members(_files(s, d), "text")


@query("""WITH f AS (SELECT coalesce(source, '') AS root, count(*) AS total, count(*) FILTER (doc_id % 7 <> 0 AND coalesce(text, '') <> '') AS mc, count(*) FILTER (doc_id IN (SELECT vec_id FROM embeddings)) AS vv FROM documents GROUP BY 1)
SELECT root, total, least(mc, vv) AS done, total - least(mc, vv) AS incomplete, (SELECT sum(total) FROM f)::BIGINT AS total_files, (SELECT sum(total - least(mc, vv)) FROM f)::BIGINT AS total_incomplete FROM f WHERE total > least(mc, vv)""")
def a6_incomplete_totals(s, d):
    x = _axes(s, d).withColumn("root", F.coalesce("source", F.lit("")))
    return catalog.incomplete_totals(x.withColumn("has_mv", F.col("has_vv")), "root", "caption").select("root", "total", "done", "incomplete", "total_files", "total_incomplete")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'none' WHEN c_custkey % 6 = 5 OR c_custkey % 5 = 4 OR c_custkey % 11 = 0 THEN 'block' WHEN (c_custkey % 6 IN (3, 4)) = (c_custkey % 5 = 3) THEN 'none' ELSE 'mv_only' END AS action FROM customer")
def u22_tier_actions(s, d):
    tiers = F.array(*map(F.lit, ("standard", "pro", "ultra", "ultra", "other")))
    k = F.col("c_custkey")
    now = F.element_at(F.array(*map(F.lit, ("standard", "pro", "pro", "ultra", "none"))), (k % 5 + 1).cast("int"))
    stored = F.when(k % 6 > 0, F.element_at(tiers, (k % 6).cast("int")))
    return _t(s, d, "customer").select(k.alias("id"), R.tier_action(stored, now, F.lit(768), F.when(k % 11 == 0, 64).otherwise(768)).alias("action"))


@query(f"WITH {_ANY_SCRIPT}, hits AS (SELECT * FROM post WHERE token IN ('fur', 'src3', 'thand')), {_SCORE} SELECT id, round(score, 6) AS score FROM scores ORDER BY scores.score DESC, id LIMIT 20")
def f6_stored_index(s, d):
    """An index that gets a third of the documents at first, then others, some of them changed; some go, segments merge."""
    path, docs = shared_path(s, "index"), _texts(s, d)
    index = segments.create(docs.where("id % 3 = 0"), path, version=2)
    index = segments.add(index, docs.where("id % 3 = 1").withColumn("weak", F.concat(F.lit("thand thand "), "weak")))
    index = segments.merge(segments.delete(index, docs.where("id % 6 = 0")))
    segments.add(index, docs.where("id % 3 > 0 or id % 6 = 0"))
    index = segments.open_index(s, path, version=2)
    return textindex.bm25(index, textindex.matching(index, ["fur", "src3", "thand"])).orderBy(F.desc("score"), "id").limit(20).select("id", _R6("score"))


@query(f"""WITH {_ANY_SCRIPT}, hits AS (SELECT a.id, 1.0 AS wt, 'of the' AS token FROM post a JOIN post b ON a.id = b.id AND a.part = b.part AND b.pos = a.pos + 1 WHERE a.token = 'of' AND b.token = 'the'), {_SCORE},
sub AS (SELECT * FROM scores WHERE id % 5 = 0) SELECT id, round(CASE WHEN hi - lo <= 1e-12 THEN 1.0 ELSE (score - lo) / (hi - lo) END, 6) AS norm FROM sub, (SELECT min(score) AS lo, max(score) AS hi FROM sub)""")
def f9_subset_scores(s, d):
    c = _searched(s, d)
    pool = _files(s, d).where("id % 5 = 0").select("id", F.lit(None).cast("double").alias("M_score"))
    return search.enrich(pool, c, {}, ["of the"]).where("M_score is not null").select("id", F.round("M_score", 6).alias("norm"))


# ------------------------------------------------------------------ search fields

_TREE = "list_concat(flatten([['g' || k || '_' || id, 'g' || k] FOR k IN range(n, 0, -1)]), ['leaf' || id, 'leaf'], CASE WHEN n > 0 THEN ['side'] ELSE [] END, ['side' || k FOR k IN range(1, n + 1)])"
_LAYERS = f"f AS (SELECT *, array_to_string({_TREE}, ' ') AS names FROM (SELECT doc_id AS id, doc_id % 6 AS n, coalesce(lang, 'xx') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents))"


def _layered(s, d):
    """Files with a tree of id % 6 levels below its top, each with a layer beside it."""
    wrap = lambda acc, k: F.concat(F.lit('{"name": "g'), k, F.lit("_"), "id", F.lit('", "cleaned_name": "g'), k, F.lit('", "children": ['), acc, F.lit(', {"name": "side", "cleaned_name": "side'), k, F.lit('"}]}'))
    levels = F.filter(F.sequence(F.lit(1), F.lit(5)), lambda k: k <= F.col("id") % 6)
    tree = F.aggregate(levels, F.concat(F.lit('{"name": "leaf'), F.col("id"), F.lit('", "cleaned_name": "leaf"}')), wrap)
    return _files(s, d).select("id", F.coalesce("lang", F.lit("xx")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"), tree.alias("tree"))


@query(f"WITH {_LAYERS} SELECT id, names FROM f")
def f3_layer_names(s, d):
    return _layered(s, d).select("id", F.array_join(fields.layer_tree_names(F.col("tree")), " ").alias("names"))


@query(f"""WITH {_LAYERS} SELECT id, concat_ws(' ', 'f_' || id || '.psd', names, nullif(source, ''), 'Arial ' || lang, 'a t' || (id % 3), nullif(text, '')) AS strong,
'hero ' || lang || ' x' || id || ' hero ' || lang || ' Start ' || lang || CASE WHEN source <> '' THEN ' ' || source ELSE '' END || ' f1 ' || lang || ' flat' AS weak FROM f""")
def f1_f2_search_fields(s, d):
    x = _layered(s, d)
    meta = F.concat(F.lit('{"layer_tree": '), "tree", F.lit(', "semantic_tags": "'), "source", F.lit('", "used_fonts": ["Arial", "'), "lang", F.lit('"], "text_content": ["Start", "'), "lang", F.lit('"]}'))
    path = F.concat(F.lit("/assets/Hero_"), "lang", F.lit("/v2/x"), "id", F.lit(".png"))
    strong = fields.strong_field(F.concat(F.lit("f_"), "id", F.lit(".psd")), meta, F.concat(F.lit('["a", "t'), F.col("id") % 3, F.lit('"]')), F.col("text"))
    weak = fields.weak_field(path, F.concat(F.lit("Hero_"), "lang"), F.lit(None).cast("string"), meta, F.col("source"), F.lit('["f1"]'), F.col("lang"), F.lit(None).cast("string"), F.lit("flat"))
    return x.select("id", strong.alias("strong"), weak.alias("weak"))


# ------------------------------------------------------------------ names, paths, records

_NAMES = {0: ("Layer {} copy 2", ""), 1: ("Character_Body_{}", "Character Body"), 2: ("Levels {}", ""), 3: ("{} hero_run-", "hero run"), 4: ("グループ {}", ""), 5: ("Sky のコピー {}", "Sky"), 6: ("copyright {}", "copyright")}
_CASES = " ".join(f"WHEN {k} THEN '{v}'" for k, (_, v) in _NAMES.items())


@query(f"SELECT doc_id AS id, CASE doc_id % 7 {_CASES} END AS name FROM documents")
def u2_layer_names(s, d):
    raw = F.element_at(F.array(*(F.format_string(f.replace("{}", "%d"), F.col("id")) for f, _ in _NAMES.values())), (F.col("id") % 7 + 1).cast("int"))
    return _files(s, d).select("id", T.clean_name(raw).alias("name"))


_BOX = "b AS (SELECT doc_id AS id, 100 + n_chars % 900 AS w, 100 + n_chars % 700 AS h, (doc_id * 37) % 1000 AS x, (doc_id * 53) % 1000 AS y, (doc_id % 10) / 10.0 AS alpha, 1000 AS cw, 1000 AS ch FROM documents)"


@query(f"""WITH {_BOX}, a AS (SELECT *, w * h / 1000000.0 AS area, sqrt((x + w / 2.0 - 500) ** 2 + (y + h / 2.0 - 500) ** 2) / (sqrt(2000000.0) / 2) AS off, (x < 100 OR x + w > 900) AND (y < 100 OR y + h > 900) AS corner FROM b)
SELECT id, CASE WHEN id % 9 = 0 THEN 'character' WHEN area > 0.9 THEN 'background' WHEN area < 0.05 AND alpha < 0.3 THEN 'effect' WHEN off < 0.3 AND area > 0.1 THEN 'character' WHEN off < 0.3 THEN 'object' WHEN corner AND area < 0.1 THEN 'ui' ELSE 'unknown' END AS kind FROM a""")
def u9_content_types(s, d):
    b = _files(s, d).select("id", (100 + F.col("n_chars") % 900).alias("w"), (100 + F.col("n_chars") % 700).alias("h"), (F.col("id") * 37 % 1000).alias("x"), (F.col("id") * 53 % 1000).alias("y"), (F.col("id") % 10 / 10.0).alias("alpha"))
    name = F.when(F.col("id") % 9 == 0, "Face 1").otherwise("q")
    return b.select("id", T.content_type(name, F.lit(1000), F.lit(1000), F.col("w"), F.col("h"), F.col("x"), F.col("y"), F.col("alpha")).alias("kind"))


@query("""SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN '/d/x' WHEN page_id % 3 = 1 THEN '/d/Resources' ELSE '/d/x' END AS storage_root, CASE WHEN page_id % 3 = 0 THEN 'assets/p' || page_id || '.png' WHEN page_id % 3 = 1 THEN 'Assets/p' || page_id || '.png' ELSE 'p' || page_id || '.png' END AS relative_path FROM pages""")
def u7_split_root(s, d):
    n = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".png"))
    path = F.concat(F.when(F.col("page_id") % 3 == 0, "/d/x/assets/").when(F.col("page_id") % 3 == 1, "/d/Resources/Assets/").otherwise("/d/x/"), n)
    return _t(s, d, "pages").select(F.col("page_id").alias("id"), T.split_root(path).alias("r")).select("id", "r.*")


@query(r"""SELECT page_id AS id, len(string_split(url, '/')) AS depth, CASE WHEN instr(url, '/assets/') > 0 THEN substr(url, 1, instr(url, '/assets/') - 1) ELSE regexp_extract(url, '^(.*)/[^/]*$', 1) END AS storage_root,
CASE WHEN instr(url, '/assets/') > 0 THEN regexp_replace(substr(url, instr(url, '/assets/')), '^/+', '') ELSE regexp_extract(url, '([^/]*)$', 1) END AS relative_path,
trim(regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', ''), '[_-]+', ' ', 'g')) AS tags FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '/([^/]*)$', '/assets/\1') ELSE url END AS url FROM pages)""")
def u5_u7_u8_url_parts(s, d):
    """Roots, relative paths, depths and name tags of the pages' own urls."""
    url = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "/([^/]*)$", "/assets/$1")).otherwise(F.col("url"))
    x = _t(s, d, "pages").select(F.col("page_id").alias("id"), url.alias("url")).withColumn("r", T.split_root(F.col("url")))
    return x.select("id", T.folder_depth(F.col("url")).cast("long").alias("depth"), "r.storage_root", "r.relative_path", T.name_tags(F.regexp_extract("url", "([^/]*)$", 1)).alias("tags"))


@query("""SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'c' || event_id WHEN 1 THEN 'd' || event_id WHEN 2 THEN 'e' || event_id WHEN 3 THEN 'plain ' || event_id ELSE '' END AS caption,
CASE event_id % 5 WHEN 0 THEN 'ui' WHEN 4 THEN 'photo' ELSE 'other' END AS image_type, CASE event_id % 5 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS n_tags FROM events""")
def u17_json_repair(s, d):
    forms = ['{"caption": "c%d", "image_type": "ui"}', '```json\n{"caption": "d%d", "tags": ["a", "b",],}\n```', 'so: "caption": "e%d", "tags": ["x"], nothing else', "[plain] %d", '{"image_type": "photo"}']
    raw = F.element_at(F.array(*(F.format_string(f, F.col("event_id")) if "%d" in f else F.lit(f) for f in forms)), (F.col("event_id") % 5 + 1).cast("int"))
    x = _t(s, d, "events").select(F.col("event_id").alias("id"), R.description(raw).alias("x"))
    return x.select("id", "x.caption", "x.image_type", F.size("x.tags").alias("n_tags"))


@query("""SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN ts::TIME >= TIME '09:00:00' AND ts::TIME < TIME '17:30:01' WHEN 1 THEN ts::TIME >= TIME '22:00:00' OR ts::TIME < TIME '06:00:01' ELSE true END AND (event_id % 8 <> 3 OR isodow(ts) <= 5) AS active FROM events""")
def u15_active_hours(s, d):
    hours = F.when(F.col("event_id") % 4 == 0, "09:00-17:30").when(F.col("event_id") % 4 == 1, "22:00-06:00").when(F.col("event_id") % 4 == 2, "soon")
    days = F.when(F.col("event_id") % 8 == 3, F.array(*map(F.lit, range(1, 6))))
    return _t(s, d, "events").select(F.col("event_id").alias("id"), R.active(F.col("ts"), hours, days).alias("active"))


@query("SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS n, json_extract_string(props, '$.k') AS k FROM events")
def p25_u20_json_columns(s, d):
    tags = F.when(F.col("event_id") % 2 == 0, '["a", "b"]').otherwise("{broken")
    m = R.allowed(R.map_or_empty(F.col("props")), ["k"])
    return _t(s, d, "events").select(F.col("event_id").alias("id"), F.size(R.array_or_empty(tags)).alias("n"), F.try_element_at(m, F.lit("k")).alias("k"))


# ------------------------------------------------------------------ audits and listings


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 7 <> 0 AND trim(text) <> '' AND starts_with(source, 'src1/') IS NOT NULL AND doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0)")
def j9_captions_without_vector(s, d):
    return audit.captions_without_vector(_axes(s, d).select("id", "caption"), _vectors(s, d).where("id % 3 = 0")).select("id")


@query("SELECT count(*) FILTER (doc_id % 7 = 0 OR text = '' OR text IS NULL) AS no_caption, count(*) FILTER (doc_id % 5 = 0) AS no_hash, count(*) FILTER (doc_id % 5 <> 0) AS hashed FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def j10_vectors_without(s, d):
    return audit.vectors_without(_axes(s, d).withColumn("hash", F.when(F.col("id") % 5 != 0, F.md5("text"))), _vectors(s, d))


@query("SELECT s_suppkey AS id, n_name AS username FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000 AND s_suppkey % 3 <> 0 AND n_nationkey % 4 <> 0")
def j12_tokens_of_users(s, d):
    tokens = _t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("user_id"), F.col("s_acctbal").cast("double").alias("expires_at"), (F.col("s_suppkey") % 3 == 0).alias("revoked"))
    users = _t(s, d, "nation").select(F.col("n_nationkey").alias("user_id"), F.col("n_name").alias("username"), (F.col("n_nationkey") % 4 != 0).alias("is_active"))
    return audit.tokens_of_users(tokens, users, F.lit(5000.0)).select("id", "username")


@query("SELECT n_nationkey AS id FROM nation WHERE n_name = 'FRANCE' OR n_nationkey = 7")
def p22_login_lookup(s, d):
    users = _t(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("username"), F.when(F.col("n_nationkey") == 7, "FRANCE").alias("email"))
    return audit.by_login(users, "FRANCE").select("id")


@query("SELECT event_id AS id, user_id AS doc, d.n_chars FROM events LEFT JOIN documents d ON doc_id = user_id WHERE event_type = 'error'")
def j14_jobs_with_captions(s, d):
    # the jobs' paths are decomposed, the files' composed
    path = lambda c, e: F.concat(F.lit(f"/caf{e}/"), F.col(c).cast("string"))
    j = _t(s, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("user_id").alias("doc"), path("user_id", "é").alias("file_path"))
    f = _files(s, d).select(path("id", "é").alias("file_path"), F.col("n_chars").alias("caption"))
    return audit.with_captions(j, f).select("id", "doc", F.col("caption").alias("n_chars"))


@query(f"WITH {_JOBS} SELECT DISTINCT user_id AS session FROM j WHERE status = 'processing' AND id % 50 = 0")
def j21_assigned_sessions(s, d):
    j = _jobs(s, d).withColumnRenamed("user_id", "session")
    return audit.assigned(j.select("session").distinct(), j.where("id % 50 = 0"))


@query("SELECT count(*) AS total, count(*) FILTER (doc_id % 7 <> 0) AS done FROM documents WHERE source IN ('src1', 'src3')")
def a9_p16_resume_totals(s, d):
    stats = _files(s, d).groupBy(F.concat(F.lit("/r/"), "source", F.lit("/x")).alias("root")).agg(F.count("*").alias("total"), F.count_if(F.col("id") % 7 != 0).alias("done"))
    return audit.resume_totals(stats, ["/r/src1/", "/r/src3"])


_PARSE = "p AS (SELECT *, CASE id % 4 WHEN 0 THEN 'parsed' WHEN 1 THEN 'failed' WHEN 2 THEN 'parsing' END AS parse_status FROM j)"


def _parsing(s, d):
    return _jobs(s, d).withColumn("parse_status", F.when(F.col("id") % 4 == 0, "parsed").when(F.col("id") % 4 == 1, "failed").when(F.col("id") % 4 == 2, "parsing"))


@query(f"WITH {_JOBS}, {_PARSE} SELECT coalesce(parse_status, 'unparsed') AS parse_status, count(*) AS n FROM p WHERE status = 'pending' GROUP BY 1")
def a12_parse_histogram(s, d):
    return audit.parse_histogram(_parsing(s, d))


@query("SELECT count(*) AS total, count(*) FILTER (doc_id % 10 = 0) AS missing_relative, count(*) FILTER (doc_id % 10 = 0) > 0 AS needs_rebuild, CASE WHEN count(*) FILTER (doc_id % 10 = 0) > 0 THEN 2 ELSE 3 END AS level, 1 + (count(*) FILTER (doc_id % 10 = 0) > 0)::INT AS n_reasons FROM documents")
def a27_build_status(s, d):
    got = audit.build_status(_files(s, d).withColumn("relative_path", F.when(F.col("id") % 10 != 0, "a/b")), index_version=1, level=0)
    return got.select("total", "missing_relative", "needs_rebuild", "level", F.size("reasons").alias("n_reasons"))


@query("SELECT '/r/' || source AS folder, count(*) AS n FROM documents GROUP BY source")
def a29_child_counts(s, d):
    return audit.child_counts(_files(s, d).withColumn("path", F.concat(F.lit("/r/"), "source", F.lit("/"), F.col("id").cast("string"))), "path")


@query("WITH n AS (SELECT max(ts) AS now FROM events), r AS (SELECT ts, now FROM events, n WHERE ts > now - INTERVAL 3600 SECOND) SELECT count(*) AS n, round(coalesce(count(*) / nullif(epoch(max(now) - min(ts)), 0) * 60, 0), 6) AS per_minute FROM r")
def a30_client_rate(s, d):
    return audit.client_rate(_t(s, d, "events"), _now(s, d), 3600).select("n", _R6("per_minute"))


@query(f"""WITH {_JOBS}, x AS (SELECT ts, id % 9 AS session, user_id FROM j, now WHERE ts > now - INTERVAL 5 MINUTE AND ts <= now),
y AS (SELECT 'session' AS level, session::VARCHAR AS key, ts FROM x UNION ALL SELECT 'user_id', user_id::VARCHAR, ts FROM x)
SELECT level, key, count(*) FILTER (ts > now - INTERVAL 1 MINUTE) AS m1, count(*) AS m5, CASE WHEN count(*) FILTER (ts > now - INTERVAL 1 MINUTE) > 0 THEN count(*) FILTER (ts > now - INTERVAL 1 MINUTE)::DOUBLE ELSE round_even(count(*) / 5.0, 1) END AS per_minute FROM y, now GROUP BY level, key, now""")
def a15_throughput_levels(s, d):
    return audit.throughput_levels(_jobs(s, d).withColumn("session", F.col("id") % 9), _now(s, d))


@query("SELECT least(25, count(*)) AS n, least(25, count(*)) AS known, least(25, count(*)) AS equal_to_the_files FROM documents")
def t11_sample(s, d):
    """A sample's rows are as many as asked for, distinct, and rows of the table, unchanged."""
    got = audit.sample(_files(s, d), 25, 7)
    same = got.join(_files(s, d).select("id", F.col("text").alias("_t")), "id", "left")
    return same.agg(F.count_distinct("id").alias("n"), F.count("text").alias("known"), F.count_if(F.col("text") == F.col("_t")).alias("equal_to_the_files"))


# ------------------------------------------------------------------ the queue


@query(f"WITH {_JOBS} SELECT DISTINCT user_id AS id FROM j WHERE id % 2 = 0 AND user_id NOT IN (SELECT user_id FROM j WHERE id % 40 = 1 AND status IN ('pending', 'processing'))")
def m1_create_jobs(s, d):
    j = _jobs(s, d).withColumn("file_path", F.col("user_id").cast("string"))
    return jobs.create(j.where("id % 40 = 1"), j.where("id % 2 = 0").select("file_path", "user_id")).select(F.col("user_id").alias("id"))


@query(f"WITH {_JOBS}, {_PARSE} SELECT id FROM p WHERE status = 'pending' AND parse_status = 'parsed' ORDER BY priority DESC, ts, id LIMIT 8")
def m2_route_by_mode(s, d):
    j = _parsing(s, d).withColumn("created_at", F.col("ts"))
    return jobs.route(j, 16, "full", override="mc_only", pressure="warning").select("id")


_ROUTES = """SELECT 'full' AS mode, id, row_number() OVER (ORDER BY coalesce(parse_status = 'parsed', false) DESC, priority DESC, ts, id) AS place FROM p WHERE status = 'pending' AND coalesce(parse_status, 'pending') <> 'parsing'
UNION ALL SELECT 'mc_only', id, row_number() OVER (ORDER BY priority DESC, ts, id) FROM p WHERE status = 'pending' AND parse_status = 'parsed'
UNION ALL SELECT 'embed_only', id, row_number() OVER (ORDER BY priority DESC, ts, id) FROM p WHERE status = 'pending' AND id % 5 < 3 AND id % 5 > 0"""


@query(f"WITH {_JOBS}, {_PARSE}, r AS ({_ROUTES}) SELECT mode, id, place FROM r WHERE place <= 40")
def m2_routes(s, d):
    """The claims of workers of each mode; embed_only takes jobs whose caption is done, and no vectors, parsed or not."""
    flags = F.when(F.col("id") % 5 == 1, '{"vision": true}').when(F.col("id") % 5 == 2, '{"vision": true, "embed": false}').when(F.col("id") % 5 == 3, '{"vision": true, "embed": true}').otherwise("{}")
    j = _parsing(s, d).withColumns({"created_at": F.col("ts"), "phase_completed": flags})
    place = F.row_number().over(search.Window.partitionBy("mode").orderBy("tier", F.desc("priority"), "created_at", "id"))
    got = [jobs.route(j, 40, m).select(F.lit(m).alias("mode"), "id", "tier", "priority", "created_at") for m in ("full", "mc_only", "embed_only")]
    return got[0].unionByName(got[1]).unionByName(got[2]).select("mode", "id", place.cast("long").alias("place"))


@query(f"WITH {_JOBS} SELECT count(*) FILTER (NOT coalesce(json_extract_string(props, '$.k') IN ('true', '1'), false) AND coalesce(json_extract_string(props, '$.k') IN ('0', 'false'), true)) AS tolerant, count(*) FILTER (coalesce(json_extract_string(props, '$.k') IN ('0', 'false'), false)) AS strict FROM j")
def p19_not_embedded(s, d):
    j = _jobs(s, d).select(F.replace("props", F.lit('"k"'), F.lit('"embed"')).alias("props"))
    return j.agg(F.count_if(jobs.not_embedded("props")).alias("tolerant"), F.count_if(jobs.not_embedded("props", strict=True)).alias("strict"))


@query(f"WITH {_JOBS}, {_PARSE} SELECT id, CASE WHEN id % 6 = 0 AND status IN ('pending', 'assigned', 'failed') THEN 'cancelled' WHEN status = 'failed' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'failed' AND NOT id % 6 = 0 AND parse_status = 'failed' THEN NULL ELSE parse_status END AS parse_status FROM p WHERE status <> 'completed'")
def m6_cancel_retry_clear(s, d):
    j = _parsing(s, d).withColumn("retry_count", F.lit(1))
    j = jobs.cancel(j, j.where("id % 6 = 0"))
    return jobs.clear_completed(jobs.retry_failed(j)).select("id", "status", "parse_status")


@query(f"WITH {_JOBS}, {_PARSE} SELECT id, CASE WHEN status = 'processing' AND (ts < now - INTERVAL 30 MINUTE OR user_id = 3) THEN 'pending' ELSE status END AS status, CASE WHEN parse_status <> 'parsing' THEN parse_status END AS parse_status FROM p, now")
def m9_m5_startup(s, d):
    j = _parsing(s, d).withColumn("assigned_at", F.col("ts")).withColumn("worker_session_id", F.col("user_id"))
    return jobs.reclaim_session(jobs.startup(j, _now(s, d)), 3).select("id", "status", "parse_status")


@query(f"WITH {_JOBS}, {_PARSE} SELECT count(*) FILTER (status = 'pending' AND parse_status = 'parsed') AS parsed, greatest(0, 5000 - count(*) FILTER (status = 'pending' AND parse_status = 'parsed')) AS deficit FROM p")
def m12_parse_deficit(s, d):
    return jobs.parse_deficit(_parsing(s, d), F.lit(5000))


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN 'resting' WHEN n_chars > 500 THEN 'active' ELSE 'idle' END AS state, count(*) AS n FROM documents GROUP BY 1")
def m17_worker_states(s, d):
    state = jobs.worker_state(F.col("id") % 5 != 0, F.when(F.col("n_chars") > 500, 1).otherwise(0))
    return _files(s, d).groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("WITH x AS (SELECT user_id AS run, event_id AS step, value AS rate, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) SELECT step, CASE WHEN previous IS NULL THEN 'start' WHEN rate < previous * 0.95 THEN 'refine' ELSE 'grow' END AS verdict FROM x")
def m18_w7_batch_growth(s, d):
    steps = _t(s, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("rate"))
    return jobs.batch_growth(steps).select("step", "verdict")


@query(None)
def m18_batch_sizes(s, d):
    """The next batch's size after each event of a user, by its rate. Each step depends on all before it: no SQL."""
    steps = _t(s, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("rate"), (F.col("event_id") % 20 / 22.0).alias("load"))
    return batching.batch_sizes(steps)


_SILENCE = 6 * 3600 * 1_000_000
_SESSIONS = f"""WITH e0 AS (SELECT user_id AS session, epoch_us(ts) AS us, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'heartbeat' WHEN event_type = 'purchase' THEN 'command' ELSE 'phase' END AS kind, CASE WHEN event_type = 'purchase' THEN 'c' || event_id ELSE event_type END AS value FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
e AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY us, event_id NULLS FIRST, kind, value NULLS FIRST) AS rn FROM e0),
u AS (SELECT epoch_ms(max(ts)) * 1000 AS until FROM events WHERE user_id IS NOT NULL), k AS (SELECT e.* FROM e, u WHERE us <= until),
w AS (SELECT *, max(CASE WHEN kind = 'heartbeat' THEN rn END) OVER b AS prev_b, max(CASE WHEN kind = 'command' THEN rn END) OVER b AS prev_c FROM k WINDOW b AS (PARTITION BY session ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT session, us, lead(us) OVER (PARTITION BY session ORDER BY rn) AS next FROM k WHERE kind = 'heartbeat')
SELECT w.session, make_timestamp(w.us) AS ts, 'handed' AS what, c.value FROM w JOIN k c ON c.session = w.session AND c.rn = w.prev_c WHERE w.kind = 'heartbeat' AND w.prev_c > coalesce(w.prev_b, 0) AND c.value IS NOT NULL
UNION ALL SELECT session, make_timestamp(us + {_SILENCE}), 'timeout', NULL FROM h, u WHERE us + {_SILENCE} < least(coalesce(next, until), until)
UNION ALL SELECT session, make_timestamp(min(us)), 'phase', value FROM k WHERE kind = 'phase' GROUP BY session, value"""


def _session_events(events):
    """Times without a zone are UTC, whatever the session's zone."""
    ts = F.col("ts")
    if events.schema["ts"].dataType.typeName() == "timestamp_ntz":
        ts = F.concat(ts.cast("string"), F.lit("Z")).cast("timestamp")
    kind = F.when(F.col("event_type").isin("view", "click"), "heartbeat").when(F.col("event_type") == "purchase", "command").otherwise("phase")
    value = F.when(F.col("event_type") == "purchase", F.concat(F.lit("c"), "event_id")).otherwise(F.col("event_type"))
    return events.select(F.col("user_id").alias("session"), ts.alias("ts"), F.col("event_id").alias("id"), kind.alias("kind"), value.alias("value"))


def _in_utc(rows):
    """ts without a zone, as UTC has it."""
    return rows.withColumn("ts", F.timestamp_add("MICROSECOND", F.unix_micros("ts"), F.expr("TIMESTAMP_NTZ'1970-01-01'")))


@query(_SESSIONS)
def m3_m8_m10_session_log(s, d):
    """Commands handed out once, timeouts, and the first of each phase, from the whole log."""
    e = _session_events(_t(s, d, "events"))
    until = e.where("session is not null").agg(sessions.whole_ms(F.max(F.unix_micros("ts")))).first()[0] or 0
    return _in_utc(sessions.sessions_log(e, until, _SILENCE))


@query(_SESSIONS)
def m3_m8_m10_session_stream(s, d):
    """The same from a stream with state and timers, run to the end of what there is."""
    stream = monitor.read_events(s, f"{d}/events*.parquet", _t(s, d, "events").schema)
    return _in_utc(sessions.drain_sessions(_session_events(stream), shared_path(s, "sessions"), _SILENCE, "0 seconds"))


@query("SELECT doc_id AS id, lang, n_chars, CASE WHEN coalesce(lang, '') IN ('fr', '') THEN 'lang' WHEN NOT coalesce(n_chars >= 500, false) THEN 'n_chars' END AS reason FROM documents")
def s16_stream_writer(s, d):
    """A stream of files is written with checks; what is rejected has the reason. Its only batch is then given again."""
    path, schema = shared_path(s, "written"), _t(s, d, "documents").schema
    rows = lambda df: df.select(F.col("doc_id").alias("id"), "lang", "n_chars")
    writer = monitor.Writer(path, "id", {"lang": ~F.col("lang").isin("fr", ""), "n_chars": F.col("n_chars") >= 500})
    writer.start(rows(monitor.read_events(s, f"{d}/documents*.parquet", schema))).awaitTermination()
    writer(rows(_t(s, d, "documents")).limit(1), 0)
    written = monitor.read_written(s, path).withColumn("reason", F.lit(None).cast("string"))
    return written.unionByName(monitor.read_rejected(s, path).select(written.columns))


@query("SELECT n_nationkey AS session, CASE WHEN n_nationkey IN (SELECT user_id FROM events) THEN 'stop' END AS handed, CASE WHEN n_nationkey NOT IN (SELECT user_id FROM events) THEN 'stop' END AS pending_command FROM nation")
def m10_pending_command(s, d):
    sessions = _t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("session"), F.lit("stop").alias("pending_command"))
    return jobs.override(sessions, _t(s, d, "events").select(F.col("user_id").alias("session"))).select("session", "handed", "pending_command")


@query("SELECT doc_id AS id, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND trim(text) <> '' AND doc_id % 3 = 0 AND doc_id % 2 = 0 AND doc_id IN (SELECT vec_id FROM embeddings) AS skip FROM documents")
def m20_skip_file(s, d):
    x = _axes(s, d).select("id", F.col("id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.lit("2024-01-01T00:00").alias("mtime"), "caption", "has_vv")
    known = x.withColumn("has_structure", F.col("id") % 3 == 0).withColumn("has_mv", F.col("id") % 2 == 0).withColumn("relative_path", F.lit("a"))
    found = x.select("id", "path", "size", F.when(F.col("id") % 5 == 0, "t1").otherwise("2024-01-01 00:00").alias("mtime"))
    return jobs.skip_file(found, known).select("id", "skip")


@query("SELECT doc_id AS id, trim(text) <> '' AS present, 1 AS depth FROM documents WHERE lang = 'de' AND source = 'src1'")
def p10_p17_u8_columns(s, d):
    x = _files(s, d).where(P.same(F.col("source"), "src1") & P.every([P.same(F.col("lang"), "de"), P.same(F.col("lang"), None)]))
    return x.select("id", P.present_trimmed(F.col("text")).alias("present"), T.folder_depth(F.col("source")).alias("depth"))


@query("SELECT 'files' AS name, 0 AS n, count(*) AS removed FROM documents UNION ALL SELECT 'vectors', 0, count(*) FROM embeddings")
def s15_reset(s, d):
    return catalog.reset(files=_files(s, d), vectors=_vectors(s, d))
