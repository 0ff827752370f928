"""Long texts as GIFs: frames are decoded one after another, whatever their number."""

import tracemalloc

import pyarrow as pa

from quireflow.llm import gif


def test_only_the_screen_is_bounded(spark):
    text = "".join(chr(32 + k * 7919 % 95) for k in range(294_900))
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string")
    stored = gif.store_gifs(docs)
    got = {r.doc_id: r for r in gif.read_gifs(stored, most_screen=16 * gif.FRAME).collect()}
    assert len(got[1].frames) > 25 and bytes(got[1].luma)[:294_900].decode() == text and len(got[1].luma) % gif.FRAME == 0
    assert bytes(got[2].luma)[:5] == b"short" and bytes(got[3].luma) == b"\xff" * gif.FRAME
    small = {r.doc_id: r for r in gif.read_gifs(stored, most_screen=gif.FRAME).collect()}
    assert small[1].luma is None and "pixels" in small[1].error and small[2].error is None
    assert sum(sum(f.hist) for f in got[1].frames) == len(got[1].luma)


def test_equal_files_whatever_else_is_encoded_with_them():
    texts = [bytes(range(256)) * n for n in (0, 1, 40, 9000)] + [b"", b"x" * 576]
    together = gif.write_gifs(texts)
    assert together == [gif.write_gifs([t])[0] for t in texts] == [gif.write_gifs([memoryview(t)])[0] for t in texts]
    for t, media in zip(texts, together, strict=True):
        shown = b"".join(canvas[..., 0].tobytes() for _, canvas in gif.read_gif(media)[2])
        assert shown[: len(t)] == t and set(shown[len(t) :]) <= {255}


def test_memory_of_a_long_text():
    """Encoding and decoding a text takes less than three times its size beside it, of what Python and numpy ask for."""
    size = 12 << 20
    text = (b"abcdefghij klmnop qrstuv " * (size // 25 + 1))[:size]
    tracemalloc.start()
    out = pa.BufferOutputStream()
    for part in gif.gif_parts([text]):
        if part is not None:
            out.write(part)
    written = tracemalloc.get_traced_memory()[1]
    media = memoryview(out.getvalue()).cast("B")
    tracemalloc.reset_peak()
    seen = sum(luma.nbytes for _, (luma, _) in gif.show_gif(media, views=(gif.LUMA, gif.BIN)))
    read = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen >= size and written < 3 * size + (64 << 20) and read < (64 << 20)
