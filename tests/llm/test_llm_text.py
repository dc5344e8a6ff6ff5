"""Operators on single texts: PII, licences, token files."""

import random
import re
import time

import brute
import cases
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from decoylens.llm import licences, pii, tokenfile

PII_PARTS = ["a@b.c", "x.y@z", "@", ".", "1", "255", "256", "10.0.0.1", " ", "-", "+49 ", "(30) ", "4111 1111 1111 1111", "555", "é", "\n", "at", " dot ", "one ", "[at]", "０"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PII_PARTS), max_size=30).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    base, every = pii.find_spans(text)
    assert base == brute.pii(text)
    assert all(set(base[k]) <= set(every[k]) for k in base)


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("write to john.doe [at] example [dot] com today", "email", "john.doe [at] example [dot] com"),
        ("or bob at site dot co dot uk, please", "email", "bob at site dot co dot uk"),
        ("or jane dot roe at mail dot example dot org (work)", "email", "jane dot roe at mail dot example dot org"),
        ("jаne@exаmple.com with Cyrillic letters", "email", "jаne@exаmple.com"),
        ("an invisible jo​hn@example.com", "email", "jo​hn@example.com"),
        ("plus four nine one seven two three four five six seven it is", "phone", "plus four nine one seven two three four five six seven"),
        ("host one nine two dot one six eight dot zero dot one!", "ip", "one nine two dot one six eight dot zero dot one"),
        ("１９２.168.0.1 in wide digits", "ip", "１９２.168.0.1"),
        ("card 4l11 1111 1111 1111 ok", "card", "4l11 1111 1111 1111"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    base, every = pii.find_spans(text)
    assert found in [text[a:b] for a, b in every[kind]] and set(base[kind]) <= set(every[kind])
    assert len(pii.masked(text)) == len(text) and found not in pii.masked(text)


@pytest.mark.parametrize("text", ["meet me at example.com", "one two three go", "почта@домен.ру", "look at the dot on it", "at dot at dot", "He said one. Then two dots"])
def test_clean_texts_have_no_spans(text):
    assert not any(pii.find_spans(text)[1].values())


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "+1" * 150_000, "a@" * 150_000, "one " * 80_000):
        base, _ = pii.find_spans(text)
        assert isinstance(base, dict)
    for text in (" " * 300_000, "a@b.cd" + " \n" * 150_000 + "(at)", "\uff0c" + "\u6f22" * 300_000, "\u0430" + "b" * 300_000, "( at " * 60_000):
        begun = time.perf_counter()
        pii.find_spans(text)
        assert time.perf_counter() - begun < 3


def test_blanks_and_zeros_keep_their_spans():
    base, _ = pii.find_spans("0" * 5000 + "1.2.3.4 and 0256.1.1.1 and 000.00.0.00255")
    assert base["ip"] == [(0, 5007), (5027, 5041)]
    _, found = pii.find_spans("bob  [at]  host (dot) org! (at)  ann (at) host.org")
    assert found["email"] == [(0, 25), (33, 50)]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", "\t", "(at)", "[ @ ]", "(dot)", "{.}", "dot", "a", "("]), max_size=14).map("".join))
def test_patterns_that_take_blanks_once_match_as_before(text):
    at = r"(?:\(\s*(?:at|@)\s*\)|\[\s*(?:at|@)\s*\]|\{\s*(?:at|@)\s*\}|<\s*(?:at|@)\s*>)\s*"
    dot = r"(?:\(\s*(?:dot|\.)\s*\)|\[\s*(?:dot|\.)\s*\]|\{\s*(?:dot|\.)\s*\}|<\s*(?:dot|\.)\s*>)\s*"
    for mine, plain in ((pii._BRACKETED_AT, r"\s*" + at), (pii._BRACKETED_DOT, r"\s*" + dot), (pii._SPOKEN_DOT, r"[ \t]+dot[ \t]+")):
        assert [m.span() for m in mine.finditer(text)] == [m.span() for m in re.finditer(plain, text, re.I)]


def test_common_pieces_outlive_rare_ones():
    cache = tokenfile.Generations(3)
    for n in range(40):
        cache.turn()
        new = {"common", f"rare{n}"}.difference(cache, cache.old)
        assert "common" not in new or n == 0
        cache.update((p, p.encode()) for p in new)
        assert cache["common"] == b"common" and len(cache) + len(cache.old) <= 9


def test_pii_rows(spark):
    docs = cases.documents(spark, [*cases.AWKWARD, (20, "a@b.cd and 4111111111111111"), (20, "call +49 30 1234567")], extra=True)
    rows = pii.digest(pii.find(docs)).collect()
    assert len(rows) == docs.count()
    expected = []
    for row in docs.collect():
        spans = brute.pii(row["text"])
        expected.append((row["doc_id"], *map(len, spans.values()), brute.sha(",".join(f"{k}:{a}:{b}" for k, v in spans.items() for a, b in v))))
    assert sorted((tuple(r)[:6] for r in rows), key=str) == sorted(expected, key=str)
    assert pii.digest(pii.find(docs.limit(0))).count() == 0


def test_whole_table_of_base_spans(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in pii.digest(pii.find(rows)).collect()}
    for r in rows.collect():
        spans = brute.pii(r["text"])
        assert got[r["doc_id"]]["base_sha256"] == brute.sha(",".join(f"{k}:{a}:{b}" for k, v in spans.items() for a, b in v))


BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def base_places(text):
    own = brute.words(text)
    return sorted((i, label) for phrase, label in BASE.items() for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["gnu", "General", "public", "license", "apache", "CC", "by", "mit", "é", "x", "sa", "nc"]), max_size=25), st.sampled_from([" ", "\n", "-", "., "]))
def test_base_phrases(parts, gap):
    found = licences.scan_text(gap.join(parts))
    places = base_places(gap.join(parts))
    assert found["places"] == [i for i, _ in places] and found["n_words"] == len(parts)
    assert found["base_labels"] == sorted({label for _, label in places})
    assert set(found["base_labels"]) <= set(found["labels"])


@pytest.mark.parametrize(
    "expression, score, labels",
    [
        ("MIT", 0.95, ["mit"]),
        ("(MIT OR GPL-2.0-only) AND Apache-2.0", 0.9, ["apache", "gpl", "mit"]),
        ("MIT OR GPL-2.0-only AND AGPL-3.0", 0.95, ["agpl", "gpl", "mit"]),
        ("GPL-2.0-or-later WITH Classpath-exception-2.0", 0.725, ["gpl"]),
        ("AGPL-3.0+ and (MIT or", 0.35, ["agpl", "mit"]),
        ("Custom-Thing or cc-by-nc-sa-4.0", 0.2, ["cc-by-nc-sa", "other"]),
        (") and", 0.0, []),
        ("((((MIT))))) AND GPL-2.0", 0.95, ["mit"]),
    ],
)
def test_expressions(expression, score, labels):
    found = licences.scan_text(f"// SPDX-License-Identifier: {expression}\ncode")
    assert set(labels) <= set(found["labels"]) and bool(labels) == bool(found["labels"]) and found["score"] == pytest.approx(score)


def test_licence_rows(spark):
    docs = cases.documents(spark, [*cases.AWKWARD, (30, "the mit license and the Apache\nLicense")], extra=True)
    rows = {(r["doc_id"], r["n_words"]): r for r in licences.digest(licences.scan(docs)).collect()}
    for d in docs.collect():
        row, places = rows[d["doc_id"], len(brute.words(d["text"]))], [i for i, _ in base_places(d["text"])]
        assert (row["n_base"], row["first_word"], row["last_word"]) == (len(places), min(places, default=None), max(places, default=None))
        assert 0 <= row["score"] <= 1
    assert licences.digest(licences.scan(docs.limit(0))).count() == 0


def test_licences_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in licences.digest(licences.scan(docs)).collect()}
    for d in docs.collect():
        places = base_places(d["text"])
        assert got[d["doc_id"]]["n_base"] == len(places) and got[d["doc_id"]]["base_labels"] == ",".join(sorted({x for _, x in places}))


SPACES = st.sampled_from([" ", "  ", "   ", "\n", "\n\n", " \n", "\n ", "\t", " ", " ", "\x1c", ""])
CHUNKS = st.sampled_from(["a", "a.", "Wort,", "x!?", "½.", "9:", "é;", "\0", "l'.", ".", "Wort", "don't", "'s", "12", "...", "é漢", "<|endoftext|>", "😀", "|"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(SPACES, CHUNKS), max_size=25).map("".join))
def test_pieces_encode_as_whole_texts(text):
    encoder = tokenfile.encoder(tokenfile.tokenizer_path())
    assert "".join(tokenfile.pieces(text)) == text
    whole = np.array([*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()
    assert encoder.encode([text]) == [whole]


def test_a_batch_looks_each_piece_up_once():
    """Before, every place of a piece was a look-up of its own."""

    class Counting(tokenfile.Generations):
        asked = 0

        def get(self, *piece):
            self.asked += 1
            return super().get(*piece)

        def __getitem__(self, piece):
            self.asked += 1
            return super().__getitem__(piece)

    encoder = tokenfile.Encoder(tokenfile.tokenizer_path())
    encoder.known = Counting(100)
    texts = ["red blue green " * 400 + "end"] * 5 + [None, "", "blue\x00red", "blue  red", "blue!!! red.<|endoftext|>", "ab;:<|endoftext|>."]
    whole = [np.array([*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts]
    for batch in (texts, texts[:7], texts):  # new, known, and from the old generation
        Counting.asked = 0
        assert encoder.encode(batch) == whole[: len(batch)] and encoder.known.asked < 60
        encoder.known.size = 0
    assert encoder.encode([None, ""]) == [whole[5]] * 2


def test_token_files_round_trip(spark, tmp_path):
    texts = [(i, t) for i, t in cases.AWKWARD if i is not None and i != 6] + [(100 + i, f"text number {i} " * i) for i in range(50)]
    docs = cases.documents(spark, texts, extra=True).repartition(5)
    files = tokenfile.write(docs, shards=4, folder=f"file://{tmp_path}/shards")
    rows = sorted(map(tuple, tokenfile.read(files).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    ordered = sorted(texts)
    assert rows == [(i, *t) for (i, _), t in zip(ordered, brute.tokens([t for _, t in ordered]))]
    wanted = [r for r in rows if r[0] in (105, 4)]
    assert sorted(map(tuple, tokenfile.read(files, doc_ids=[4, 105, 999]).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == wanted


def test_token_files_of_awkward_rows(spark, tmp_path):
    docs = cases.documents(spark, [(None, "b"), (None, None), (3, "y"), (3, "x"), (3, None)])
    files = tokenfile.write(docs, shards=3, folder=f"file://{tmp_path}/shards")
    rows = tokenfile.read(files).orderBy("start").collect()
    expected = brute.tokens([None, "b", None, "x", "y"])
    assert [(r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows] == expected
    assert [r["doc_id"] for r in rows] == [None, None, 3, 3, 3]
    none = tokenfile.write(docs.limit(0), shards=3, folder=f"file://{tmp_path}/none")
    assert none.count() == 0 and tokenfile.read(none).count() == 0


def test_frames_are_independent_and_checked(tmp_path):
    import zstandard

    path = tmp_path / "one.zst"
    rng = random.Random(1)
    docs = [(i, np.array([rng.randrange(50_000) for _ in range(i * 7)] + [0], "<u4")) for i in range(20)]
    writer = tokenfile.ShardWriter(pa.OSFile(str(path), "wb"))
    for i, ids in docs:
        writer.add(i, ids.tobytes())
    writer.close()
    reader = tokenfile.ShardReader(pa.OSFile(str(path), "rb"))
    assert reader.documents == [(i, len(ids)) for i, ids in docs]
    for number in (13, 2, 19, 0):
        assert (reader.read(number) == docs[number][1]).all()
    # A reader without any knowledge of the tables gets all ids in order.
    whole = zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True).read()
    assert whole == b"".join(ids.tobytes() for _, ids in docs)
    data = bytearray(path.read_bytes())
    data[int(reader.offsets[5]) + int(reader.table[5, 0]) - 6] ^= 1
    path.write_bytes(bytes(data))
    broken = tokenfile.ShardReader(pa.OSFile(str(path), "rb"))
    assert (broken.read(4) == docs[4][1]).all()
    with pytest.raises(Exception):
        broken.read(5)


def test_words_of_bytes_are_those_of_the_pattern():
    from decoylens.llm.tables import WORD_BYTES

    text = "".join(map(chr, range(300))) + "Éa-b C_d"
    assert [w.decode() for w in text.encode().translate(WORD_BYTES).split()] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(text))


def test_words_of_columns_are_those_of_the_pattern(spark):
    from decoylens.llm.tables import words

    rows = cases.documents(spark, [(50, "".join(map(chr, range(300))) + "Éa-b C_d K"), *cases.AWKWARD])
    for r in rows.select("text", words(F.col("text")).alias("w")).collect():
        assert r["w"] == brute.words(r["text"])
