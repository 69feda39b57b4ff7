"""Recognition with stand-ins for the networks, and ingestion as a stream."""

import numpy as np

from pagewright.operators import imaging, inference
from pagewright.streaming import ingest_once


def detector(tensor):
    """Dark pixels are text."""
    return (tensor[0, 0] < -1).astype(float) * 0.95


def recogniser(tensor):
    """Every crop says " ab " in four steps, the second of them twice as sure."""
    steps = np.array([[0, 0, 0, 1], [0.05, 0.95, 0, 0], [0, 0.1, 0.9, 0], [0, 0, 0, 1]])
    return np.stack([steps] * len(tensor))


def stubs():
    return detector, recogniser, ["", "a", "b", " "], lambda t: np.array([[0.05, 0.95]] * len(t))


def picture():
    img = np.full((96, 128, 3), 255, np.uint8)
    img[20:34, 20:100] = 0
    img[60:74, 20:60] = 0
    return img


def test_lines_of_a_page():
    lines = inference.page_lines(picture(), *stubs())
    assert [(x["line_id"], x["text"]) for x in lines] == [(1, "ab"), (2, "ab")] and lines[0]["t"] < 34 < lines[1]["t"]
    assert lines[0]["l"] < 20 and lines[0]["r"] > 100 and len(lines[0]["extents"]) == 2 and lines[0]["extents"][0][1] == lines[0]["extents"][1][0]
    assert inference.page_lines(picture(), *stubs(), least=0.99) == [] and inference.page_lines(np.full((64, 64, 3), 255, np.uint8), *stubs()) == []
    assert inference.turned([picture()] * 17, stubs()[3]) == [True] * 17


def test_character_extents():
    assert inference.character_extents([0.25, 0.75], 0, 100) == [(0.0, 50.0), (50.0, 100.0)] and inference.character_extents([0.5], 0, 10) == [(0.0, 10.0)] and inference.character_extents([], 0, 1) == []


def test_sessions_are_kept_for_each_language():
    made = []
    make = lambda path, threads: made.append((path, threads)) or (lambda t: t)
    one = inference.session("rec", "en", "a", 1, make)
    assert inference.session("rec", "en", "a", 1, make) is one and inference.session("rec", "de", "b", 1, make) is not one
    inference.session("rec", "en", "a", 4, make)
    assert made == [("a", 1), ("b", 1), ("a", 4)]


def test_pages_fail_alone(spark):
    def own():  # by value: workers don't know this module
        import numpy as np

        steps = np.array([[0, 0, 0, 1], [0.05, 0.95, 0, 0], [0, 0.1, 0.9, 0], [0, 0, 0, 1]])
        return (lambda x: (x[0, 0] < -1).astype(float) * 0.95), (lambda x: np.stack([steps] * len(x))), ["", "a", "b", " "], None

    img = picture()
    rows = [(1, 1, 128, 96, bytearray(img.tobytes())), (1, 2, 128, 96, bytearray(b"short")), (1, 3, 128, 96, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, page_no int, width int, height int, pixels binary")
    got = inference.recognise_pages(df, own).collect()
    assert sorted((r.page_no, r.status, r.text) for r in got if r.page_no == 1) == [(1, "Done", "ab")] * 2 and {r.page_no for r in got if r.status == "Failed"} == {2, 3}


def test_files_arrive(spark, tmp_path):
    box, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    box.mkdir()
    (box / "a.png").write_bytes(imaging.to_png(np.zeros((4, 6, 3), np.uint8)))
    (box / "b.doc").write_bytes(b"x")
    first = ingest_once(spark, str(box), str(out), str(state)).collect()
    assert {(r.kind, r.page_no, r.status) for r in first} == {("image", 1, "Done"), ("rejected", None, "Failed")}
    (box / "c.pdf").write_bytes(b"broken")
    assert sorted(r.kind for r in ingest_once(spark, str(box), str(out), str(state)).collect()) == ["image", "pdf", "rejected"]
    assert ingest_once(spark, str(box), str(out), str(state)).count() == 3
