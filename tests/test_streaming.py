"""Streams: pairs of files that arrive apart are those of the batch form."""

import os
import random

import pytest

from weftline.sources import datasets, files
from weftline.streaming import pairing

DAY = 1_700_000_000


def put(path, text, at):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (DAY + at, DAY + at))


def everything(top, mode):
    """The files of a mode: some stems lack a part, some have few images."""
    out = []
    for i in range(12):
        if i != 3:
            out.append((top / "json" / f"s{i}.json", f'{{"n": {i}}}'))
        if mode == "caption" and i != 5:
            out.append((top / "cap" / f"s{i}.txt", f" words of {i}\n"))
        if mode == "panorama" and i != 6:
            out.append((top / "img" / f"s{i}" / "panorama" / "panorama_rgb.png", "x"))
        if mode == "multi_view":
            out += [(top / "img" / f"s{i}" / "orbit" / f"orbit_{k}.png", "x") for k in range(1 + i)]
    return out


@pytest.mark.parametrize("mode", ["caption", "panorama", "multi_view"])
def test_any_order_of_arrival_gives_the_batch_result(spark, tmp_path, mode):
    options = {"views": (3, 5), "seed": 7}
    arriving = everything(tmp_path, mode)
    folders = {"json_dir": "json", "caption_dir": "cap", "image_dir": "img"}
    random.Random(mode).shuffle(arriving)
    for name in folders.values():
        (tmp_path / name).mkdir()
    at = {k: str(tmp_path / v) for k, v in folders.items()}
    run = lambda: pairing.pair_files(spark, str(tmp_path / "out"), str(tmp_path / "ck"), mode, **at, **options, wait="1 hour", late="1 minute").awaitTermination()
    third = len(arriving) // 3
    for turn in range(3):  # parts of one stem come in different runs
        for path, text in arriving[turn * third : len(arriving) if turn == 2 else (turn + 1) * third]:
            put(path, text, 60 * turn)
        run()
    for later in (5 * 3600, 10 * 3600):  # time passes: scenes of other days
        put(tmp_path / "json" / f"z{later}.json", "{}", later)
        run()
    rows = datasets.read(spark, str(tmp_path / "out")).collect()
    parts = lambda r: (r["raw"], r["caption"] if mode == "caption" else None, list(r["image_paths"]) if mode == "multi_view" else [r["image_path"]] if mode == "panorama" else [])
    want = {r["stem"]: parts(r) for r in files.load_by_mode(spark, mode, *at.values(), **options).collect() if r["stem"][0] == "s"}
    pairs = [r for r in rows if r["status"] == "paired"]
    assert {r["stem"]: parts(r) for r in pairs} == want and 6 <= len(want) == len(pairs) < 12
    left = {r["stem"]: r["lacks"] for r in rows if r["status"] == "unpaired" and r["stem"][0] == "s"}
    lost = {"caption": {"s3": "scene", "s5": "caption"}, "panorama": {"s3": "scene", "s6": "images"}, "multi_view": {"s0": "images", "s1": "images", "s3": "scene"}}[mode]
    assert left == lost


def test_views_are_those_of_the_batch_form(spark):
    rows = [(f"p{i}", f"/x/{i}/{k}.png") for i in range(20) for k in range(4 + i % 5)]
    sets = files.view_sets(spark.createDataFrame(rows, "parent string, path string"), 4, 6, 3)
    for r in sets.collect():
        assert r["image_paths"] == pairing.views_of(r["parent"], [p for q, p in rows if q == r["parent"]], 4, 6, 3)
