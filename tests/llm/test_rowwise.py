import base64
import bz2
import gzip
import hashlib
import html
import random
import re
import time
import urllib.parse
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import chat, pii, secrets

TEXTS = st.lists(st.sampled_from([*"ab<>|/\\[]INSTs%\n ", "</s>", "<s>", "<|", "[INST]", "[/INST]", "é", "🎉"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS), max_size=4))
def test_chat_round_trip(turns):
    out, _ = chat.format_conversation(turns)
    assert chat.parse(out) == turns


def test_chat_mask_and_digest(spark):
    rows = [(1, 1, "assistant", "B </s>"), (1, 0, "user", None), (1, 2, "assistant", "C"), (None, 0, None, "x"), (2, 0, "user", "q"), (2, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.formatted(df)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 7 and got[2].n_turns == 2
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nB </s>\nassistant\nC\n").hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"B </s>C").hexdigest()
    assert got[None].turns_sha256 == hashlib.sha256(b"\nx\n").hexdigest()
    text, mask = chat.format_conversation([("user", ""), ("assistant", "B </s>"), ("assistant", "C")])
    assert got[1].formatted_chars == len(text) and "".join(chat.unescape(text[a:b]) for a, b in mask) == "B </s>C"
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0


SECRET = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'


@pytest.mark.parametrize("layers", ["b", "z", "g", "u", "p", "bp", "pb", "bbz", "upb", "zbpu"])
def test_nested_secrets_are_found_and_mapped(layers):
    blob = SECRET
    for kind in layers:
        raw = blob.encode()
        blob = {
            "b": lambda: base64.b64encode(raw).decode(),
            "z": lambda: base64.b64encode(zlib.compress(raw)).decode(),
            "g": lambda: base64.b64encode(gzip.compress(raw, mtime=0)).decode(),
            "u": lambda: "".join(f"\\u{ord(c):04x}" for c in blob),
            "p": lambda: "".join(f"%{b:02X}" for b in raw),
        }[kind]()
    text = f"é before {blob} after"
    base, spans = secrets.scan(text)
    found = [s for s in spans if s[0] == "assign"]
    assert not [s for s in base if s[0] == "assign"] and len(found) == 1
    # The secret is all but the closing quote, which takes its share of the encoded text.
    start, end, quote = 9, 9 + len(blob.rstrip("=")), 2 * len(blob) // len(SECRET) + 4
    assert start - 1 <= found[0][1] <= start + 3 and end - quote <= found[0][2] <= end + 3


def test_large_compressed_layers_are_scanned_in_pieces(monkeypatch):
    monkeypatch.setattr(secrets, "PIECE", 1000)
    monkeypatch.setattr(secrets, "OVERLAP", 100)
    inner = "filler words " * 300 + SECRET + " more words" * 300
    blob = base64.b64encode(zlib.compress(inner.encode())).decode()
    _, spans = secrets.scan(f"x {blob} y")
    assert {k for k, _, _ in spans} == {"assign", "hex"} and {a for _, a, _ in spans} == {2}


def test_secret_scan_ends_on_cycles_and_keeps_base_spans(spark):
    assert secrets.scan("%25" * 50 + "41")[1] == []
    assert secrets.scan(SECRET) == ([("assign", 0, 49), ("hex", 9, 49)],) * 2
    df = spark.createDataFrame([(1, None), (2, ""), (3, SECRET), (3, SECRET), (4, "secret=short AKIA1234 AKIA" + "Z" * 16)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.spans) for r in secrets.found(df).collect())
    assert got == [(1, 0, 0, 0, ""), (2, 0, 0, 0, ""), (3, 1, 0, 1, "assign:0:49,hex:9:49")] + [(3, 1, 0, 1, "assign:0:49,hex:9:49"), (4, 0, 1, 0, "access:22:42")]
    assert secrets.found(df.limit(0)).count() == 0


def test_secrets_match_a_plain_scan_on_documents(spark, sf_dir):
    import re

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in secrets.query(spark, sf_dir).collect()}
    for d, text in docs:
        want = []
        want += [("assign", *m.span()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "") if len(m[2]) >= 8]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 32]
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(want, key=lambda s: (s[1], secrets.KINDS.index(s[0]))))
        assert got[d].base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def _wrapped(raw: bytes, width: int, end: str = "\n") -> str:
    blob = base64.b64encode(raw).decode()
    return end.join(blob[i : i + width] for i in range(0, len(blob), width))


@pytest.mark.parametrize("width, end", [(64, "\n"), (76, "\r\n"), (76, "\n  "), (61, "\n")])
@pytest.mark.parametrize("pack", [bytes, zlib.compress, gzip.compress])
def test_wrapped_base64_is_one_region(width, end, pack):
    random.seed(3)
    for n in (30, 40, 51, 52, 53):
        words = [" ".join("".join(random.choices("abcdefghij", k=7)) for _ in range(30)) for _ in range(2)]
        blob = _wrapped(pack(f"{words[0][:n]} {SECRET} {words[1]}".encode()), width, end)
        text = f"see\nthis:\n{blob}\nplain words behind"
        _, spans = secrets.scan(text)
        assert [k for k, _, _ in spans] == ["assign", "hex"]
        if pack is bytes:
            at = lambda i: 10 + i + len(end) * (i // width)
            a, b = (n + 1) * 4 // 3, -(-(n + len(SECRET)) * 4 // 3)
            assert spans[0] == ("assign", at(a), at(b - 1) + 1)


@pytest.mark.parametrize("glue", ["a/", "path/to/", "n+", "xyz_", "-", "word\n", "it\n"])
@pytest.mark.parametrize("pack", [bytes, zlib.compress])
def test_base64_behind_letters_of_the_alphabet_is_found(glue, pack):
    for pad in ("", " ", "  "):
        blob = base64.b64encode(pack((SECRET + pad).encode())).decode()
        _, spans = secrets.scan(f"{glue}{blob} and more")
        assert [k for k, _, _ in spans] == ["assign", "hex"] and spans[0][1] >= len(glue)


@pytest.mark.parametrize("char", ["\u00a0", "\u3000", "\ufeff", "\u200b", "\f", "\x1b[31m", "\0", "\xe9"])
@pytest.mark.parametrize("coding", ["utf-8", "latin-1", "utf-16-le", "utf-16-be", "utf-16"])
@pytest.mark.parametrize("pack", [bytes, zlib.compress, gzip.compress])
def test_decoded_layers_are_scanned_whatever_their_characters(char, coding, pack):
    for filler in ("some words ", "some other words here "):
        raw = f"{filler}{char} and {SECRET} rest {char}".encode(coding, "replace")
        _, spans = secrets.scan(f"x {base64.b64encode(pack(raw)).decode()} y")
        assert [k for k, _, _ in spans] == ["assign", "hex"] and spans[0][1] >= 2


def test_all_members_of_compressed_data_are_scanned():
    key = "AKIA" + "Q" * 16
    members = [gzip.compress(x.encode()) for x in ("first words", f"x {SECRET[:20]}", f"{SECRET[20:]} y", f"last {key} words")]
    for raw in (b"".join(members), b"\0\0".join(members), zlib.compress(b"first words") + zlib.compress(f"{SECRET} {key}".encode()), gzip.compress(b"a") + b"junk" + gzip.compress(f"{SECRET} {key}".encode())):
        _, spans = secrets.scan(f"x {base64.b64encode(raw).decode()} y")
        assert {k for k, _, _ in spans} == {"assign", "hex", "access"}
    assert len(secrets.scan(base64.b64encode(zlib.compress(SECRET.encode(), 0)).decode())[1]) == 2


def test_layers_of_any_depth_are_unwrapped():
    deep = "".join("%" + "25" * 150 + f"{ord(c):02X}" for c in SECRET)
    assert [(a >= 2, b <= 2 + len(deep)) for k, a, b in secrets.scan(f"x {deep} y")[1] if k == "assign"] == [(True, True)]
    assert len(secrets.scan("AKIA" + "B" * 11 + "%" + "25" * 1000 + "43")[1]) > 1


@pytest.mark.parametrize("packs", [(bytes,), (bytes, bytes), (zlib.compress,), (gzip.compress, zlib.compress)])
def test_regions_over_the_border_of_a_piece_are_whole(monkeypatch, packs):
    monkeypatch.setattr(secrets, "PIECE", 1000)
    monkeypatch.setattr(secrets, "OVERLAP", 100)
    random.seed(5)
    word = lambda: "".join(random.choices("ghijklmnop", k=7))
    for inner in (SECRET, f'token{" " * 1500}=  "{"q" * 40}'):
        raw = " ".join([*(word() for _ in range(600)), inner, *(word() for _ in range(600))]).encode()
        for pack in packs:
            raw = _wrapped(pack(raw), 76).encode()
        text = " ".join([*(word() for _ in range(200)), raw.decode(), *(word() for _ in range(200))])
        spans = secrets.scan(f"x {base64.b64encode(zlib.compress(text.encode())).decode()} y")[1]
        assert {k for k, _, _ in spans} >= {"assign"} and {a for _, a, _ in spans} == {2}


def test_hits_inside_of_base_spans_are_kept():
    text = f"secret={base64.b64encode(b'password=hunter2222').decode()} y"
    base, spans = secrets.scan(text)
    assert base == [("assign", 0, 35)] and len(spans) == 2 and spans[0] == base[0] and spans[1][:2] == ("assign", 7)


def test_further_escapes_and_packings():
    wide = "".join(f"\\U{ord(c):08x}" for c in SECRET)
    assert {k for k, _, _ in secrets.scan(f"x {wide} y")[1]} == {"assign", "hex"}
    assert secrets.scan("password&equals;hunter2hunter2 &amp; more")[1] == [("assign", 0, 30)]
    assert secrets.scan("password&amp;equals;hunter2hunter2 &nosuch; &amp")[1] == [("assign", 0, 34)]
    for pack in (bz2.compress, lambda x: zlib.compress(x, wbits=-15), lambda x: bz2.compress(b"other words") + bz2.compress(x)):
        for filler in ("", "some other words here " * 3000):
            blob = _wrapped(pack(f"{filler}{SECRET} and {filler}".encode()), 76)
            _, spans = secrets.scan(f"x {blob} y")
            assert {k for k, _, _ in spans} >= {"assign", "hex"} and spans[0][1] >= 2


def plain_hits(text, depth=0):
    """The secrets of a text and of all that a plain decoder makes of its whole tokens, as texts."""
    found = {text[a:b] for _, a, b in secrets.base_spans(text)}
    whole = [urllib.parse.unquote(text, "latin-1"), re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), text), html.unescape(text)]
    for token in re.findall(r"[A-Za-z0-9+/]{16,}={0,2}", text):
        try:
            raw = base64.b64decode(token, validate=True)
        except ValueError:
            continue
        for inflate in (bytes, zlib.decompress, gzip.decompress, bz2.decompress):
            try:
                whole.append(inflate(raw).decode("latin-1"))
            except (OSError, EOFError, ValueError, zlib.error):
                pass
    return found.union(*(plain_hits(x, depth + 1) for x in set(whole) - {text})) if depth < 9 else found


def test_random_nestings_match_a_plain_decoder(monkeypatch):
    rng, hits = random.Random(17), []
    right = secrets.base_spans
    monkeypatch.setattr(secrets, "base_spans", lambda t: [hits.append(t[a:b]) or (k, a, b) for k, a, b in right(t)])
    for _ in range(150):
        text = " ".join(rng.choice(["words", "more", SECRET, "AKIA" + "Z" * 14, "api_key: 'abcdefgh12'"]) for _ in range(4))
        for _ in range(rng.randrange(5)):
            pack = rng.choice([bytes, zlib.compress, gzip.compress, bz2.compress])
            code = rng.choice(
                [
                    lambda t: base64.b64encode(pack(t.encode("latin-1"))).decode(),  # noqa: B023
                    lambda t: urllib.parse.quote(t, safe=""),
                    lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
                    lambda t: "".join(f"&#{ord(c)};" for c in t),
                ]
            )
            text = f"some {code(text)} text" if len(text) < 6000 else text
        with monkeypatch.context() as plain:
            plain.setattr(secrets, "base_spans", right)
            want = plain_hits(text)
        hits.clear()
        secrets.scan(text)
        assert want <= set(hits)


def test_time_grows_with_the_hits_only():
    blob = base64.b64encode(SECRET.encode()).decode()
    began = time.perf_counter()
    base, spans = secrets.scan(f"password=hunter2hunter2 {blob}\n\n" * 20_000)
    assert len(base) == 20_000 and len(spans) == 60_000 and time.perf_counter() - began < 30


def test_feistel_shift_is_a_bijection_without_fixed_points():
    for n in (2, 3, 10, 97, 1000):
        f = pii.Feistel(b"key", "t", n)
        out = [f.shifted(x) for x in range(n)]
        assert sorted(out) == list(range(n)) and all(x != y for x, y in enumerate(out)) and [f.unshifted(y) for y in out] == list(range(n))
    valid = lambda x: x % 3 == 0
    f = pii.Feistel(b"key", "t", 300)
    assert sorted(f.shifted(x, valid) for x in range(0, 300, 3)) == list(range(0, 300, 3))


@pytest.mark.parametrize(
    "value, kind",
    [("+1 (017) 555-7713", "phone"), ("8.196.197.208", "address"), ("4785380592391139", "card"), ("4111 1111 1111 1111", "card"), ("2024-02-29", "date"), ("29.02.2024", "date"), ("12/25/2023", "date"), ("123-45-6789", "ssn"), ("GB82 WEST 1234 5698 7654 32", "iban"), ("an.19@mail5.example.com", "email")],
)
def test_pseudonyms_keep_format_and_link(value, kind):
    names = pii.Pseudonyms("k")
    out, spans = pii.pseudonymised(f"é a {value} b {value}.", names)
    assert [s[0] for s in spans] == [kind, kind] and value not in out
    first = out[4:].split(" b ")[0]
    assert out == f"é a {first} b {first}." and len(first) == len(value) or kind == "address"
    assert pii.find(f"é a {first} b", names)[0][0] == kind and names.of(kind, first) is not None


def test_values_side_by_side_are_all_found():
    names = pii.Pseudonyms("k")
    text = "a +1 (826) 555-4081 190.137.223.204 x.19@mail5.example.com 4785380592391139 1.2.3.999 8.8.8.8"
    assert [k for k, _, _ in pii.pseudonymised(text, names)[1]] == ["phone", "address", "email", "card", "address"]


def test_clean_texts_and_edges_stay(spark):
    names = pii.Pseudonyms("k")
    for text in ("", "plain words", "version 1.2.3 of 2.0", "1234567890123456", "999.1.1.1 and 2024-13-45", "MIT 2.0, section 4.1.", "a" * 100 + "@"):
        assert pii.pseudonymised(text, names) == (text, [])
    df = spark.createDataFrame([(1, None), (None, ""), (2, "x 8.8.8.8"), (2, "x 8.8.8.8")], "doc_id long, text string")
    got = [(r.doc_id, r.n_values, r.text) for r in pii.masked(df, "k").collect()]
    assert (1, 0, None) in got and (None, 0, "") in got and len({t for d, n, t in got if d == 2}) == 1 and pii.masked(df.limit(0), "k").count() == 0


def test_dates_keep_widths_and_order():
    names = pii.Pseudonyms("k")
    for value in ("1/2/2024", "3.4.2024", "1/12/2024", "10/1/2024", "03/25/2024", "3/25/2024", "25/03/2024", "2024/01/02", "31.12.2099", "1900-01-01"):
        new = names.date(value)
        assert new != value and [len(x) for x in re.split("[./-]", new)] == [len(x) for x in re.split("[./-]", value)]
        assert pii.find(f"x {new} y", names)[0][:3] == ("date", 2, 2 + len(new))
        assert (int(re.split("[./-]", new)[1]) > 12) == (value in ("03/25/2024", "3/25/2024"))
    first = [f"{m:02}/{d:02}/{y}" for y in (2023, 2024) for m in range(1, 13) for d in range(13, 29)]
    assert len({names.date(x) for x in first}) == len(first)
    assert names.date("02.01.2024").split(".")[::-1] == names.date("2024-01-02").split("-") == names.date("02/01/2024").split("/")[::-1]


def test_phone_numbers_are_linked_in_all_forms():
    names = pii.Pseudonyms("k")
    forms = ("+1 415 555 2671", "(415) 555-2671", "415-555-2671", "+14155552671", "+1 (415) 555-2671")
    assert len({re.sub(r"\D", "", names.phone(x))[-10:] for x in forms}) == 1
    assert re.sub(r"\D", "", names.phone("+49 30 1234567")) == re.sub(r"\D", "", names.phone("+49301234567")) and names.phone("+49 30 1234567").startswith("+49 ")


def plain_values(text, names):
    """Values found by trying every place of the text, with a pattern for each kind; e-mail addresses first."""
    kinds = {
        "phone": [r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\w)", r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\w|\.\d)", r"(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])"],
        "address": [r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)"],
        "date": [r"\d{4}-\d\d-\d\d(?=T\d|(?!\w|-\d))", r"\d{4}/\d\d/\d\d(?!\w|/\d)", r"\d\d?\.\d\d?\.\d{4}(?!\w|\.\d)", r"\d\d?/\d\d?/\d{4}(?!\w|/\d)"],
        "ssn": [r"\d{3}-\d\d-\d{4}(?!\w|-\d)"],
        "card": [r"\d{13,19}(?!\w)", r"\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}(?!\w)", r"\d{4}([ -])\d{6}\1\d{5}(?!\w)"],
        "iban": [r"[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"],
    }
    ahead = {"phone": lambda c, form: c not in "+(" if form == 2 else c != "+", "address": lambda c, _: c != ".", "date": lambda c, _: c not in "./-", "ssn": lambda c, _: c != "-", "card": lambda c, _: True, "iban": lambda c, _: True}
    taken, out = set(), []
    for m in re.finditer(r"(?<![\w.+%-])[\w+%][\w.+%-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", text):
        out.append(("email", *m.span()))
        taken |= set(range(*m.span()))
    at = 0
    while at < len(text):
        before, found = text[at - 1] if at else " ", None
        if at not in taken and (text[at].isascii() and (text[at].isalnum() or text[at] in "+(")) and not (before.isascii() and (before.isalnum() or before == "_")):
            for kind, forms in kinds.items():
                for k, form in enumerate(forms):
                    m = re.compile(form, re.ASCII).match(text, at) if ahead[kind](before, k) else None
                    if m and found is None:
                        found = (kind, *m.span())
        if found and not taken & set(range(*found[1:])) and getattr(names, found[0])(text[found[1] : found[2]]) is not None:
            out.append(found)
            at = found[2]
        else:
            at += 1
    return sorted(out, key=lambda x: x[1])


def test_values_match_a_plain_search_on_documents(spark, sf_dir):
    names = pii.Pseudonyms("k")
    got = {r.doc_id: r for r in pii.masked(spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet"), "k").collect()}
    n = 0
    for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").collect():
        want = plain_values(r.text or "", names)
        assert got[r.doc_id].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        n += len(want)
    assert n > 20


def test_values_of_edge_cases(nasty, empty):
    long = "call +1 (826) 555-4081 or mail an.19@mail5.example.com now " * 4000
    out, spans = pii.pseudonymised(long, pii.Pseudonyms("k"))
    assert len(spans) == 8000 and len(out) == len(long)
    assert pii.masked(empty, "k").count() == 0 and pii.masked(nasty, "k").count() == nasty.count()
    with pytest.raises(ValueError):
        pii.masked(nasty, "")


def test_chat_and_secrets_of_edge_cases(spark, nasty, empty):
    assert secrets.found(nasty).count() == nasty.count() and secrets.found(empty).count() == 0
    long = "plain words here " * 60_000 + f"password=hunter2hunter2 {base64.b64encode(SECRET.encode()).decode()}"
    assert [k for k, _, _ in secrets.scan(long)[1]] == ["assign", "assign", "hex"]
    talk = "words </s> [INST] <| " * 50_000
    rows = [(1, 0, "user", talk, "x", 1), (1, 1, "assistant", talk, "y", 2), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string, loss_start long")
    got = {r.conv_id: r for r in chat.digests(chat.formatted(df)).collect()}
    assert got[1].loss_chars == len(talk) and got[1].loss_sha256 == hashlib.sha256(talk.encode()).hexdigest() and got[None].n_turns == 1
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0
