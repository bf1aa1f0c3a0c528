"""The file source by ranges, layer trees and search fields, and the search for batch sizes."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from lodestone.functions import fields
from lodestone.operators import batching
from lodestone.sources import assets, files


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + b"\x08\x06\0\0\0"


def jpg(w, h, before=0):
    app = b"".join(b"\xff\xe1" + struct.pack(">H", 60_002) + b"\0" * 60_000 for _ in range(before))
    return b"\xff\xd8" + app + b"\xff\xc4" + struct.pack(">H", 4) + b"ab" + b"\xff\xc2" + struct.pack(">H", 11) + b"\x08" + struct.pack(">HH", h, w) + b"\x03"


def test_assets_by_ranges(spark, tmp_path):
    psd = b"8BPS" + struct.pack(">H", 1) + b"\0" * 6 + struct.pack(">HIIHH", 3, 70, 90, 8, 3)
    made = {"a/x.png": png(640, 480), "a/b/y.JPEG": jpg(33, 44, before=3), "z.psd": psd, "a/bad.png": b"GIF89a", "a/b/c/cut.jpg": b"\xff\xd8\xff", "empty.jpg": b"", ".hid/q.png": png(1, 1), "a/node_modules/q.png": png(1, 1), "n.txt": b"4"}
    for name, data in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    big = tmp_path / "a/big.png"
    with open(big, "wb") as f:
        f.write(png(7, 9))
        f.truncate(3 << 30)  # 3 GB that take no disk
    assets.register(spark)
    want = {"x.png": ("PNG", 640, 480, "a", 1), "y.JPEG": ("JPG", 33, 44, "a/b", 2), "z.psd": ("PSD", 90, 70, "", 0), "bad.png": ("PNG", None, None, "a", 1), "cut.jpg": ("JPG", None, None, "a/b/c", 3), "empty.jpg": ("JPG", None, None, "", 0), "big.png": ("PNG", 7, 9, "a", 1)}
    for n in (1, 3, 64):
        rows = {r["name"]: r for r in spark.read.format("assets").option("partitions", n).load(str(tmp_path)).collect()}
        assert {k: (r.format, r.width, r.height, r.folder, r.depth) for k, r in rows.items()} == want
    assert rows["bad.png"].error == "no PNG header" and rows["cut.jpg"].error == "no JPEG frame" and rows["x.png"].error is None
    assert rows["big.png"].hash == hashlib.sha256(struct.pack("<q", 3 << 30) + png(7, 9).ljust(8192, b"\0") + b"\0" * 8192).hexdigest()
    big.unlink()
    whole = {r["name"]: (r.hash, r.size, r.modified) for r in files.discover(spark, str(tmp_path)).collect()}
    assert {k: (r.hash, r.size, r.modified.replace(microsecond=r.modified.microsecond // 1000 * 1000)) for k, r in rows.items() if k in whole} == whole and len(whole) == 5  # Spark passes over empty files


def test_ranges_read_little(tmp_path):
    import pyarrow.fs as fs

    path = tmp_path / "x.jpg"
    path.write_bytes(jpg(5, 6, before=50))
    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        r = assets.Ranges(f, path.stat().st_size)
        r.content_hash()
        assert assets._jpg(r) == (5, 6) and r.read < 2 * 8192 + 9 * 60
    assert [assets.parser_of(n)[0] for n in ("a.PSD", "b.jpeg", "c.JPG", "d.gif", "png")] == ["PSD", "JPG", "JPG", None, None]


def test_layer_names_of_any_depth(spark):
    deep = '{"name": "leaf"}'
    for i in range(500):
        deep = f'{{"name": "g{i}", "children": [{deep}, {{"name": "leaf"}}]}}'
    trees = [
        '{"name": "Root", "children": [{"name": "Sky_01", "cleaned_name": "Sky", "children": [{"name": "b", "cleaned_name": "b"}, {"name": "Sky"}]}, {"cleaned_name": "only"}, 3, {"name": null, "children": {"x": 1}}]}',
        deep, "no json", None, "[1]", '{"children": [{"name": "Root", "cleaned_name": "Root"}]}',
    ]
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(trees)], "id int, t string").select("id", fields.layer_tree_names(F.col("t")).alias("n")).orderBy("id").collect()]
    assert got[0] == ["Sky_01", "Sky", "b", "only"] and got[1] == [*(f"g{i}" for i in range(499, -1, -1)), "leaf"] and got[2:] == [[], [], [], []]


def test_search_fields(spark):
    meta = '{"layer_tree": {"name": "Root", "children": [{"name": "Hero_1", "cleaned_name": "Hero"}]}, "semantic_tags": "hero run", "used_fonts": ["Arial", "Noto"], "text_content": ["Start", 1]}'
    row = ("Hero_Run.psd", meta, '["a", "b"]', "OCR", "/Assets/Hero_Run/v2/x.psd", "Hero", None, "note", '["f1"]', "ui", None, "flat")
    cols = "file_name metadata user_tags ocr_text file_path folder_path relative_path user_note folder_tags image_type scene_type art_style".split()
    df = spark.createDataFrame([row, (None,) * 12, (*row[:1], "no json", "{}", "", *row[4:])], ", ".join(f"{c} string" for c in cols))
    c = F.col
    strong = fields.strong_field(*map(c, cols[:4]))
    weak = fields.weak_field(c("file_path"), c("folder_path"), c("relative_path"), c("metadata"), c("user_note"), c("folder_tags"), *map(c, cols[9:]))
    got = [tuple(r) for r in df.select(strong, weak).collect()]
    assert got[0] == ("Hero_Run.psd Hero_1 Hero hero run Arial Noto a b OCR", "hero run hero Start 1 note f1 ui flat")
    assert got[1] == ("", "") and got[2] == ("Hero_Run.psd", "hero run hero note f1 ui flat")


def replay(rates):
    """Sizes, whys and modes of one run, one after another."""
    s, out = batching.Search(*batching.LIMITS["vlm"]), []
    for rate, load in rates:
        out.append((*s.after(rate, load), s.mode))
    return out


def test_batch_sizes_find_the_best_one(spark):
    """A rate that rises to size 34 and falls beyond: the sizes on the way, and where they stay."""
    s, sizes, whys = batching.Search(*batching.LIMITS["vlm"]), [], []
    for _ in range(17):
        rate = s.size if s.size <= 34 else 20.0
        size, why = s.after(rate)
        sizes.append(size)
        whys.append(why)
    assert sizes[:8] == [3, 5, 8, 12, 17, 23, 30, 38] and whys[8] == "refine" and sizes[8] == 30
    assert sizes[9:12] == [31, 33, 36] and sizes[12] == 33 and 34 in sizes and s.mode == "locked" and s.size == 34
    stay = [s.after(34.0) for _ in range(8)]
    assert [w for _, w in stay].count("probe") == 1 and s.after(34.0, 0.95) == (0, "abort") and s.after(34.0, 0.86) == (1, "emergency")
    assert batching.Search(1, 128, 2, mode="locked", best=10.0).after(7.9) == (2, "refine") and batching.Search(1, 128, 2, mode="locked", best=10.0).after(8.1) == (2, "locked")


@pytest.mark.parametrize("phase", ["vlm"])
def test_batch_sizes_by_run(spark, phase):
    import random

    rng = random.Random(1)
    runs = {k: [(rng.uniform(1, 10), rng.choice([0.1, 0.5, 0.86, 0.2])) for _ in range(n)] for k, n in ((1, 300), (2, 1), (None, 40), (4, 77))}
    rows = [(k, i, *x) for k, v in runs.items() for i, x in enumerate(v)]
    rng.shuffle(rows)
    got = {}
    for r in batching.batch_sizes(spark.createDataFrame(rows, "run long, step long, rate double, load double"), phase).collect():
        got.setdefault(r.run, {})[r.step] = (r["size"], r.why, r.mode)
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == {k: replay(v) for k, v in runs.items()}
