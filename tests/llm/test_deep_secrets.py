"""op3 on deep layers: the time follows the input, and the spans are those of the source."""

import zlib
import random
import gzip
import bz2
import base64
import time

import pytest

from tallyforge.llm import secrets

SECRET = "token=abcdefgh12345678"


def nested(depth):
    data = SECRET.encode()
    for _ in range(depth):
        data = base64.b64encode(data)
    return data.decode()


def timed(text):
    began = time.perf_counter()
    found = secrets.scan(text)
    return time.perf_counter() - began, found


def test_base64_of_depth_40():
    text = f"see {nested(40)} here"
    took, (base, spans) = timed(text)
    assert base == [] and took < 60
    assert [k for k, a, b in spans if k == "assign"]
    # Every layer around the secret begins at the first letter of the region.
    assert min(a for _, a, b in spans) == 4 and all(4 <= a < b <= len(text) - 5 for _, a, b in spans)


@pytest.mark.parametrize("depth", [1, 5, 10])
def test_spans_of_nested_base64_are_the_letters_that_hold_them(depth):
    _, spans = secrets.scan(nested(depth))
    end = len(SECRET)
    for _ in range(depth):
        end = -(-4 * end // 3)
    assert ("assign", 0, end) in spans


def test_time_of_nested_base64_follows_its_size():
    short, long = (timed(nested(d))[0] for d in (14, 22))  # 10 times as long
    assert long < 40 * short + 2


UNITS = [("%", "25", "%41"), ("&", "amp;", "&#65;"), ("&", "#38;", "&#65;"), ("\\", "u005c", "\\u0041"), ("\\", "x5C", "\\x41")]


@pytest.mark.parametrize("first, unit, last", UNITS)
def test_a_million_levels_of_an_escape(first, unit, last):
    levels = 1_000_000 // len(unit)
    text = f"token={first}{unit * levels}{last[1:]}bcdefgh x"
    took, (_, spans) = timed(text)
    assert took < 30
    assert ("assign", 0, len(text) - 2) in spans  # token=Abcdefgh, from the innermost layer


@pytest.mark.parametrize("first, unit, last", UNITS)
@pytest.mark.parametrize("levels", [1, 15, 16, 17, 18, 40])
def test_short_and_long_chains_give_the_same_innermost_span(first, unit, last, levels):
    text = f"a token={first}{unit * levels}{last[1:]}bcdefgh x token={first}{unit * 2}{last[1:]}bcdefgh"
    _, spans = secrets.scan(text)
    at = text.index(" x token")
    assert ("assign", 2, at) in spans and ("assign", at + 3, len(text)) in spans


def test_packed_data_inside_of_packed_data(monkeypatch):
    def deflated(raw):
        engine = zlib.compressobj(9, zlib.DEFLATED, -15)
        return engine.compress(raw) + engine.flush()

    monkeypatch.setattr(secrets, "PIECE", 1 << 14)
    # Packed twice, the inner data are longer than a piece.
    noise = random.Random(3).randbytes(40_000).translate(bytes(range(128)) * 2).replace(b"%", b" ").replace(b"&", b" ").replace(b"\\", b" ")
    for body in (b"token=abcdefgh12345678", noise + b" token=abcdefgh12345678 " + noise):
        for outer in (gzip.compress, zlib.compress, bz2.compress, deflated):
            for inner in (gzip.compress, zlib.compress, bz2.compress, deflated):
                blob = base64.b64encode(outer(inner(body))).decode()
                spans = [s for s in secrets.scan(f"so {blob} on")[1] if s[0] == "assign"]
                assert spans and all(3 <= a < b <= 3 + len(blob) for _, a, b in spans), (outer, inner, len(body))
