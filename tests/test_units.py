import base64
import random
import struct

from pyspark.sql import functions as F

from lodestone.functions import predicates as P
from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import catalog, jobs, reconcile
from lodestone.plans.decompose import fallback, parse_response, weights
from lodestone.sources import files


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_weights_sum_to_one_and_borrow():
    for kind in ("visual", "keyword", "semantic", "balanced", "unknown"):
        for axes in (["V"], ["V", "M"], ["V", "S", "M"], ["V", "S", "M", "X"]):
            assert abs(sum(weights(kind, axes).values()) - 1) < 1e-9
    assert abs(weights("visual", ["V", "S", "M", "X"])["X"] - 0.15) < 1e-9
    assert weights("balanced", ["X"]) == {"X": 1.0}


def test_plans():
    p = fallback("forest without people")
    assert p.excluded == ["people"] and p.vector_query == "forest" and p.keywords == ["forest without people"]
    p = fallback("art/hero_v2.psd")
    assert p.filters == {"format": "PSD", "folder_path": "art"} and p.query_type == "keyword" and "hero" in p.keywords
    p = parse_response('x {"query_type": "visual", "keywords": ["sky", "people sky"], "exclude_keywords": "people"} y', "sky")
    assert p.query_type == "visual" and p.keywords == ["sky"] and p.negative == "people"
    assert parse_response("no json", "q").keywords == ["q"] and parse_response('{"query_type": 3}', "q").query_type == "balanced"


def test_vectors(spark):
    z, v = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, V.cosine(z, v), V.l2_normalize(v), V.l2_normalize(z), V.truncate(v, 1), V.fit_to(v, 3)) == (None, [0.6, 0.8], [0.0, 0.0], [1.0], [0.6, 0.8, 0.0])


def test_text(spark):
    assert one(spark, T.clean_name(F.lit("Character_Body_01")), T.clean_name(F.lit("Layer 1 copy 2")), T.clean_name(F.lit(None).cast("string"))) == ("Character Body", "", "")
    assert one(spark, T.path_terms(F.lit("Assets/Hero_Run/v2/hero-01.PNG")), T.path_terms(F.lit(None).cast("string"))) == (["hero", "run"], [])
    box = lambda name, w, h, x, y, alpha=1.0: T.content_type(*map(F.lit, (name, 100, 100, w, h, x, y, alpha)))
    assert one(spark, box("a", 100, 91, 0, 0), box("a", 100, 90, 0, 0), box("Face 2", 1, 1, 0, 0), box("a", 9, 9, 0, 0, 0.2), box("a", 20, 20, 40, 40), box("a", 20, 20, 0, 0), box("a", 20, 20, 0, 40)) == ("background", "character", "character", "effect", "object", "ui", "unknown")
    names = {"Levels 3": "", "레이어 1 복사": "레이어 1", "12 hero_run-": "hero run", "x": "", "水": "水", "copyright": "copyright", "★": ""}
    assert one(spark, *(T.clean_name(F.lit(n)) for n in names)) == tuple(names.values())
    assert one(spark, T.semantic_tags(F.array(*map(F.lit, ["Group 1/hero_run", "hero run/Face 01"]))))[0] == "hero run Face"
    assert tuple(one(spark, T.split_root(F.lit("/d/resources/assets/a.png")))[0]) == ("/d/resources", "assets/a.png")
    assert tuple(one(spark, T.split_root(F.lit("/d/x/a.png")))[0]) == ("/d/x", "a.png")


def test_words_of_any_script(spark):
    from lodestone.operators import textindex

    docs = spark.createDataFrame([(1, "Für_dich", "год 2020"), (2, "한국 그림", None), (3, "f r", "plain")], "id long, strong string, weak string")
    index = textindex.postings(docs)
    found = lambda *k: {r.id for r in textindex.matching(index, list(k)).collect()}
    assert [found(k) for k in ("FÜR", "fur", "한국", "Год", "f r")] == [{1}, {1}, {2}, {1}, {3}]
    assert {r.id: r.dl for r in textindex.lengths(docs).collect()} == {1: 4, 2: 2, 3: 3}
    assert {r.id for r in textindex.phrase(index, "für dich").collect()} == {1}
    assert one(spark, T.path_terms(F.lit("Hero/한국_그림")), T.query_tokens(F.lit("(한국) hero!"))) == (["hero", "한국", "그림"], ["한국", "hero"])


def test_predicates(spark):
    df = spark.createDataFrame([(1, "Cat", ["Red"]), (2, None, None), (3, "", [])], "id long, t string, tags array<string>")
    ids = lambda c: [r.id for r in df.where(c).orderBy("id").collect()]
    assert ids(P.classified(F.col("t"), "cat", True)) == [1] and ids(P.classified(F.col("t"), "cat", False)) == [1, 2, 3]
    assert ids(P.equals_ci(F.col("t"), None)) == [1, 2, 3] and ids(P.has_tag(F.col("tags"), "red")) == [1] and ids(P.tag_contains(F.col("tags"), "e")) == [1]


def test_failures_and_claims(spark):
    j = spark.createDataFrame([(1, "processing", 0, 1), (2, "processing", 1, 1)], "id long, status string, retry_count int, max_retries int")
    assert [(r.status, r.retry_count) for r in jobs.after_failure(j, j).orderBy("id").collect()] == [("pending", 1), ("failed", 2)]
    assert [jobs.claim_size(5, p) for p in ("critical", "danger", "warning", "ok")] == [0, 1, 2, 5]


def test_near_hashes_and_sync_with_copies(spark):
    h = spark.createDataFrame([(1, 0), (2, 0), (3, 3), (4, -1)], "id long, hash long")
    assert {(r.a, r.b, r.distance) for r in reconcile.near_hashes(h).collect()} == {(1, 2, 0), (1, 3, 2)}
    e = spark.createDataFrame([], "path string, hash string")
    assert reconcile.sync_plan(e, e).count() == 0


def test_near_hashes_of_64_elements(spark, tmp_path):
    """Pairs that differ in elements 21 to 64, at distances to 10, are found, and none beyond."""
    import random

    from lodestone.queries import queries

    rnd, rows = random.Random(1), {}
    for i in range(0, 60, 3):
        rows[i] = [rnd.choice((-1.0, 1.0)) for _ in range(64)]
        for j, n in ((1, rnd.randint(1, 10)), (2, 11)):
            flip = set(rnd.sample(range(20, 64), n))
            rows[i + j] = [-x if k in flip else x for k, x in enumerate(rows[i])]
    spark.createDataFrame([(i, v, 0) for i, v in rows.items()], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    away = lambda a, b: sum((x > 0) != (y > 0) for x, y in zip(rows[a], rows[b], strict=True))
    want = {(a, b, away(a, b)) for a in rows for b in rows if a < b and away(a, b) <= 10}
    assert {tuple(r) for r in queries()["j20_near_hashes_64"](spark, str(tmp_path)).collect()} == want and len(want) >= 20


def test_rollup_of_deep_folders(spark):
    deep = "/".join("abcdefghijk")
    got = {r.folder: (r.total, r.done) for r in catalog.ancestor_rollup(spark.createDataFrame([(deep, 2, 1), ("a", 1, 1)], "root string, total long, done long")).collect()}
    assert len(got) == 11 and got[deep] == (2, 1) and got["a"] == (3, 2)


def test_upsert_inserts_and_keeps(spark):
    base = spark.createDataFrame([(1, "a", "u"), (2, "b", "v")], "id long, name string, note string")
    new = spark.createDataFrame([(2, None), (3, "c")], "id long, name string")
    assert sorted(map(tuple, catalog.upsert(base, new, "id", ["name"]).collect())) == [(1, "a", "u"), (2, None, "v"), (3, "c", None)]


def test_numbers_of_large_keys(spark):
    """Keys over the limit are numbered range by range as a window does; null is a key, clashing names stay."""
    from pyspark.sql import Window

    from lodestone.operators.ranking import numbered

    df = spark.range(3000).selectExpr("case when id % 3 = 0 then 'hot' when id % 3 = 1 then null else cast(id % 40 as string) end as k", "hash(id) % 500 as v", "id")
    order = [F.desc("v"), "id"]
    for keys in (["k"], []):
        want = df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
        for most in (100, 10_000):
            got = numbered(df, keys, order, most=most)
            assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert numbered(df.limit(0), ["k"], order, most=1).count() == 0 and numbered(df.limit(0), [], order, most=1).count() == 0


def test_streams_run_to_their_end(spark, tmp_path):
    from lodestone.streaming import monitor

    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:00:30")]
    events = spark.createDataFrame(rows, "user_id long, t string").select("user_id", F.to_timestamp("t").alias("ts"))
    events.write.parquet(str(tmp_path / "in"))
    got = monitor.drain(monitor.live_sessions(monitor.read_events(spark, str(tmp_path / "in"), events.schema)), str(tmp_path / "out"))
    assert sorted((r.user_id, r.online.minute, r.beats) for r in got.collect()) == [(1, 0, 2), (1, 10, 1), (2, 0, 1)]
    (tmp_path / "none").mkdir()
    assert monitor.drain(monitor.live_throughput(monitor.read_events(spark, str(tmp_path / "none"), events.schema)), str(tmp_path / "out2")).count() == 0


def test_discover_sidecars_archive(spark, tmp_path):
    for name, data in (("a/x.png", b"1" * 10), ("a/y.JPEG", b"2" * 9000), (".hid/z.png", b"3"), ("a/n.txt", b"4")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    import hashlib

    got = {r["name"]: r for r in files.discover(spark, str(tmp_path / "in")).collect()}
    assert set(got) == {"x.png", "y.JPEG"} and got["y.JPEG"]["format"] == "JPG" and got["x.png"]["folder"] == "a"
    assert got["x.png"]["hash"] == hashlib.sha256(struct.pack("<q", 10) + b"1" * 10).hexdigest()
    assert got["y.JPEG"]["hash"] == hashlib.sha256(struct.pack("<q", 9000) + b"2" * 9000).hexdigest()
    df = spark.range(3)
    files.export_archive(spark, str(tmp_path / "ar"), {"t": df}, tier="pro")
    assert files.import_archive(spark, str(tmp_path / "ar"), ["t"])["t"].count() == 3
    files.write_sidecars(df, str(tmp_path / "js"))
    assert spark.read.json(str(tmp_path / "js")).count() == 3


def test_python_columns(spark):
    b = base64.b64encode(struct.pack("<2f", 1.5, -2)).decode()
    df = spark.createDataFrame([("é", b), (None, None)], "s string, v string")
    assert [tuple(r) for r in df.select(files.nfc(F.col("s")), files.decode_vectors(F.col("v"))).collect()] == [("é", [1.5, -2.0]), (None, None)]


def test_without_training_operators():
    """The registry works where the training-data operators have been removed."""
    import subprocess
    import sys

    code = "import sys; sys.modules['lodestone.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'v1_knn_visual' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_near_hashes_by_brute_force(spark):
    """Random hashes with near copies at all distances, and many that share most bits, with and without divided values."""
    rng = random.Random(4)
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    hashes = []
    for _ in range(60):
        h = rng.getrandbits(64)
        for d in (0, 1, 2, 5, 8, 9, 10, 11, 12):
            hashes.append(h ^ sum(1 << b for b in rng.sample(range(64), d)))
    hashes += [rng.getrandbits(16) << 48 | 0x1234567890AB for _ in range(250)]
    rows = [*((i, signed(h)) for i, h in enumerate(hashes)), (9998, None), (9999, signed(hashes[3]))]
    for within, data, full in ((10, rows, 1 << 14), (10, rows, 200), (6, rows[:600], 100), (2, rows, 50), (25, rows[:150], 1 << 14), (10, rows[:1], 5)):
        first, want = {}, []
        for i, h in data:
            if h is not None:
                first.setdefault(h, i)
        ids = [(i, h) for h, i in first.items()]
        for k, (i, h) in enumerate(ids):
            want += [(min(i, j), max(i, j), n) for j, g in ids[:k] if (n := ((h ^ g) & (1 << 64) - 1).bit_count()) <= within]
        want += [(first[h], i, 0) for i, h in data if h is not None and i != first[h]]
        assert sorted(map(tuple, reconcile.near_hashes(spark.createDataFrame(data, "id long, hash long"), within, full=full).collect())) == sorted(want)
    assert reconcile.near_hashes(spark.createDataFrame([], "id long, hash long")).count() == 0


def test_names_are_unique(spark):
    names = ["a.png", "a.png", "a_1.png", "a_1.png", "b", "b", "c.x.png", "c.x.png", "a.png", "a_2.png", None, "d_7.png", "d_7.png"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string")
    got = [r.stored_name for r in catalog.unique_names(df, "name", "id").orderBy("id").collect()]
    assert got[:6] == ["a.png", "a_1.png", "a_1_1.png", "a_1_2.png", "b", "b_1"] and got[8:10] == ["a_2.png", "a_2_1.png"] and got[11:] == ["d_7.png", "d_7_1.png"]
    known = [g for g in got if g]
    assert len(set(known)) == len(known) == 12


def test_pool_modes(spark):
    mode = lambda *m, **how: jobs.pool_mode(spark.createDataFrame([(x,) for x in m], "mode string"), **how).first().pool
    assert [mode("full", "mc_only"), mode("embed_only", "mc_only", None), mode("full", "embed_only"), mode(None, None), mode("full"), mode()] == ["mc_only", "mc_only", "embed_only", "full", "full", "auto"]
    assert [mode(None, general="embed_only"), mode("full", general="mc_only"), mode(general="mc_only", auto=False)] == ["embed_only", "mc_only", "mc_only"]


def test_claims_by_mode(spark):
    rows = [(1, 9, "parsing", None), (2, 1, "parsed", '{"vision": true}'), (3, 5, None, '{"vision": 1, "embed": 0}'), (4, 3, "failed", '{"vision": true, "embed": true}')]
    j = spark.createDataFrame(rows, "id long, priority int, parse_status string, phase_completed string").withColumns({"status": F.lit("pending"), "created_at": F.lit(0)})
    ids = lambda *how, **k: [r.id for r in jobs.route(j, *how, **k).collect()]
    assert [ids(9, "full"), ids(9, "mc_only"), ids(9, "embed_only"), ids(9, "full", override="embed_only"), ids(3, "full", pressure="danger"), ids(3, "full", pressure="critical")] == [[2, 3, 4], [2], [3, 2], [3, 2], [2], []]


def test_what_the_catalog_does_not_know_is_not_compared(spark):
    known = spark.createDataFrame([("a", None, None), ("b", 1, None), ("c", None, "2024-01-01 00:00"), ("d", 2, "x")], "path string, size long, mtime string")
    known = known.withColumns({"caption": F.lit("c"), "relative_path": F.lit("r"), **{f"has_{k}": F.lit(True) for k in ("vv", "mv", "structure")}})
    found = spark.createDataFrame([(p, 1, "2024-01-01T00:00") for p in "abcde"], "path string, size long, mtime string")
    assert {r.path: r.skip for r in jobs.skip_file(found, known).collect()} == {"a": True, "b": True, "c": True, "d": False, "e": False}


def test_load_levels(spark):
    level = lambda **m: one(spark, jobs.load_level({k: F.lit(v) for k, v in m.items()}))[0]
    assert [level(cpu=75, memory=75), level(cpu=79, gpu_temp=74), level(gpu_temp=90), level(gpu_memory=85.0, cpu=0), level(cpu=None)] == ["warning", "normal", "critical", "danger", "normal"]


def test_paths_and_negation_in_queries():
    p = fallback("assets/hero/night")
    assert p.filters == {"folder_path": "assets/hero/night"} and p.keywords == ["assets/hero/night", "hero", "night"] and p.query_type == "keyword"
    p = fallback("2024/v2/sky")
    assert p.keywords[1:] == ["sky"] and p.filters["folder_path"] == "2024/v2/sky"
    p = fallback("배경/한국_그림/my hero.PNG")
    assert p.keywords[1:] == ["배경", "한국", "그림", "my", "hero"] and p.filters == {"folder_path": "배경/한국_그림", "format": "PNG"}
    assert fallback("사람이 없는 숲").excluded == ["사람"] and fallback("사람이 없는 숲").vector_query == "숲"
    assert fallback("고양이 말고 개").excluded == ["고양이"] and fallback("밤이 아닌 하늘").excluded == ["밤"]
    assert fallback("night other than city").excluded == ["city"] and parse_response('{"negative_query": "people"}', "사람 없는 숲").excluded == []


def test_dhash_by_brute_force(spark):
    rng, rows = random.Random(5), []
    for i, (w, h) in enumerate([(9, 8), (32, 20), (7, 3), (1, 1), (100, 41), (40, 40), (40, 40), (0, 4)]):
        flat = [9] * (w * h) if i == 5 else [y * w + x for y in range(h) for x in range(w)] if i == 6 else [rng.randrange(256) for _ in range(w * h)]
        rows.append((i, flat, w, h))
    want = {}
    for i, grey, w, h in rows:
        if w and h:
            area = lambda x, y: [grey[r * w + c] for r in range(y * h // 8, max((y + 1) * h // 8, y * h // 8 + 1)) for c in range(x * w // 9, max((x + 1) * w // 9, x * w // 9 + 1))]  # noqa: E731, B023
            mean = lambda x, y: sum(area(x, y)) / len(area(x, y))  # noqa: E731, B023
            value = sum(1 << y * 8 + x for y in range(8) for x in range(8) if mean(x, y) > mean(x + 1, y))
            want[i] = value - (1 << 64) if value >> 63 else value
    got = {r.i: r.h for r in spark.createDataFrame(rows, "i int, grey array<int>, w int, h int").select("i", V.dhash(F.col("grey"), F.col("w"), F.col("h")).alias("h")).collect()}
    assert got == want | {7: None} and got[5] == 0 and got[6] == 0
    assert one(spark, V.dhash(F.array(*(F.lit(9 - i % 9) for i in range(72))), F.lit(9), F.lit(8)))[0] == -1


def test_pruned_neighbours(spark, tmp_path):
    """The rows of a scan from a part of the cells, where vectors lie in clusters; from all, if need be, where they don't."""
    from lodestone.operators import knn, vectorindex

    rng = random.Random(3)
    heads = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(30)]
    near = [(i, [x + rng.gauss(0, 0.05) for x in heads[i % 30]]) for i in range(900)]
    near += [(900, near[0][1]), (901, [0.0] * 8), (902, None)]
    loose = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    for name, rows in (("near", near), ("loose", loose)):
        v = spark.createDataFrame(rows, "id long, embedding array<double>")
        cells = vectorindex.write(v, str(tmp_path / name))
        for q, k in ((rows[0][1], 15), (rows[7][1], 3), (loose[3][1], 40), ([0.0] * 8, 3)):
            same = lambda df: [(r.id, round(r.similarity, 12)) for r in df.collect()]
            assert same(cells.nearest(q, k)) == same(knn.nearest(v, q, k))
        if name == "near":
            assert len(cells.cell) > 20 and len(cells.needed(rows[7][1], 10)) < len(cells.cell) / 3
    none = vectorindex.write(spark.createDataFrame([], "id long, embedding array<double>"), str(tmp_path / "none"))
    assert none.nearest([1.0], 3).count() == 0


def test_pages_while_rows_come(spark):
    from lodestone.operators.search import page_after

    rows = [(i, v) for i, v in enumerate([5.0, None, 3.0, 5.0, 1.0, 3.0, None, 2.0])]
    seen, last, df = [], None, spark.createDataFrame(rows, "id long, s double")
    for step in range(9):
        page = page_after(df, "s", last, 2).collect()
        seen += [r.id for r in page]
        if not page:
            break
        last = page[-1].s, page[-1].id
        df = df.unionByName(spark.createDataFrame([(100 + step, 9.0)], "id long, s double"))  # before the place
    assert seen == [0, 3, 2, 5, 7, 4, 1, 6]


def test_new_analysis_keeps_what_users_entered(spark):
    base = spark.createDataFrame([("a", "old", "n", 3), ("b", "b", "m", None)], "file_path string, mc_caption string, user_note string, user_rating int")
    patch = spark.createDataFrame([("a", None, "x", 5), ("c", "new", "y", 1)], "file_path string, mc_caption string, user_note string, user_rating int")
    got = catalog.insert_files(base, patch, F.lit("now"))
    assert sorted(map(tuple, got.collect())) == [("a", None, "n", 3), ("b", "b", "m", None), ("c", "new", "y", 1)]


def test_descriptions_are_parsed_once(spark):
    """The plan parses an answer as it is and repaired, once each, whatever the number of fields; odd answers keep their values."""
    from lodestone.functions.records import description

    rows = ["{'caption': 'x', \"image_type\": \"ui\"", "  ```JSON\n{}\n```", '[{"caption": "a", "tags": ["b",]', None, "", '"caption": "q", "tags": ["r", "s"]', "{{["]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, raw string").select("i", description(F.col("raw")).alias("x")).select("i", "x.*")
    assert [(r.caption, r.image_type, len(r.tags)) for r in got.orderBy("i").collect()] == [("x", "ui", 0), ("```JSON ```", "other", 0), ("a", "other", 1), ("", "other", 0), ("", "other", 0), ("q", "other", 2), ("", "other", 0)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 2


def test_near_pairs_by_brute_force(spark):
    """Copies meet in all pairs, whatever the blocks; repeated ids aren't paired with each other, nulls with nothing."""
    rnd = random.Random(5)
    kinds = [rnd.getrandbits(64) - (1 << 63) for _ in range(5)]
    kinds += [k ^ 1 << 7 ^ 1 << 41 for k in kinds] + [0, -1]
    data = [(i // 2 if i % 17 == 1 else i, kinds[i * i % 12]) for i in range(150)] + [(None, 0), (500, None), (501, 0), (501, 0)]
    mask, items = (1 << 64) - 1, [(i, h) for i, h in data if i is not None and h is not None]
    for within in (0, 2, 10):
        want = sorted((a, b, d) for a, g in items for b, h in items if a < b and (d := ((g ^ h) & mask).bit_count()) <= within)
        for block in (1, 7, 1024):
            assert sorted(map(tuple, reconcile.near_pairs(spark.createDataFrame(data, "id long, hash long"), within, block=block).collect())) == want
    assert reconcile.near_pairs(spark.createDataFrame([], "id long, hash long")).count() == 0
