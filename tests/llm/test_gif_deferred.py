"""GIF code streams whose clear code comes late or never."""

import random

import pytest

from quireflow.llm import gif


def deferred(pixels, code_bits, clear_after=None):
    """A code stream of an encoder that goes on with a full table, with one clear code after so many codes if wanted; by bits."""
    roots = {bytes([i]): i for i in range(1 << code_bits)}
    bits, size, n = [], 1 << code_bits, 0

    def put(code, width):
        bits.extend(code >> k & 1 for k in range(width))

    put(size, code_bits + 1)
    table, following, width, prefix = dict(roots), size + 2, code_bits + 1, b""
    for p in pixels:
        here = prefix + bytes([p])
        if here in table:
            prefix = here
            continue
        put(table[prefix], width)
        n += 1
        if following < 4096:
            if following == 1 << width and width < 12:
                width += 1
            table[here] = following
            following += 1
        prefix = bytes([p])
        if n == clear_after:
            put(size, width)
            table, following, width = dict(roots), size + 2, code_bits + 1
    put(table[prefix], width)
    put(size + 1, width)
    bits += [0] * (-len(bits) % 8)
    return bytes(sum(b << k for k, b in enumerate(bits[i : i + 8])) for i in range(0, len(bits), 8)), n


@pytest.mark.parametrize("code_bits", [2, 4, 8])
@pytest.mark.parametrize("clear_after", [None, 500, 6001])
def test_codes_go_on_with_a_full_table(code_bits, clear_after):
    rng = random.Random(code_bits)
    pixels = bytes(rng.randrange(1 << code_bits) for _ in range(60_000))
    data, n = deferred(pixels, code_bits, clear_after)
    assert n > 9000
    assert gif.lzw_decode(data, code_bits, len(pixels)) == pixels
    assert len(gif.lzw_decode(data[: len(data) // 2], code_bits, len(pixels))) < len(pixels)
