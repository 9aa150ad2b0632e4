"""Each query against a plain version, on the test tables and on awkward rows."""

import hashlib
import math
import struct
import zlib
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from conftest import DATA, compared

from tidewell.llm import embedding_join, language_id, line_dedup, maxent, mpeg_audio, packing, personal_data, shingle_join, token_counts, word_bpe
from tidewell.llm.queries import ORACLE, QUERIES

SF = f"{DATA}/sf0.001"
LONG = "word pair and more " * 3000


def thue_morse(pair):
    """The two letters in the order that makes sums of powers equal if they are swapped."""
    return "".join(pair[i.bit_count() % 2] for i in range(2048))


AWKWARD = [
    None, "", " \n\t ", "a", "two words", "Ünïcode ΣΑΣ İstanbul ﬁ é 日本語 テスト", "x" * 30_000, LONG, LONG, LONG + "end", "<|startoftext|> a <|endoftext|>", "don't you'll I'VE 12345 1e5 $%^&*", "a b c​d\x1ce\x85f",
    "mail a.b+c@x-y.co.uk, a@b.c_d@e.f and a@b..c; 1.2.3.4.5.6.7.8 or 256.1.1.1 with 4111 1111 1111 1111 and 4111-1111-1111-1112 +1 (555) 123-4567 +1.2", "😀 mail 😀 q@w.e 😀", "4" * 400, "@" * 300 + "a.b" * 300, "+1" + "-" * 3000 + "1",
    "one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten", "ONE two three  four five six seven eight\nnine ten", "\x00 nul \x00", "naïvè Ｆｕｌｌ ｗｉｄｔｈ ½ ǅ ß ẞ", "line\nline\nline",
]


@pytest.fixture(scope="module")
def awkward(spark):
    """The texts above, in a table that has columns of names that operators may use themselves."""
    rows = [(1000 + i, t, ("en", None, "de")[i % 3], None if i % 4 == 0 else f"s{i % 3}", 0, 1, 2, "x") for i, t in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, score long, start long, _row string")


@pytest.fixture(scope="module")
def documents(spark, awkward):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").union(awkward.select("doc_id", "text", "lang", "source"))


@pytest.fixture(scope="module")
def rows(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.where("doc_id < 0")


def by_id(df, *columns, key="doc_id"):
    found = df.collect()
    out = {r[key]: tuple(r[c] for c in columns) for r in found}
    assert len(out) == len(found)
    return out


def odd_vectors(spark):
    v = [[1.0, 0.0, 0.0], [0.99, 0.1, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 0.0], None, [], [1.0, None, 0.0], [float("nan"), 1.0, 0.0], [float("inf"), 0.0, 0.0], [-1.0, 0.0, 0.0], [1e-30, 0.0, 0.0], [3e38, 0.0, 0.0], [1.0, 0.0], [0.95, 0.31, 0.0]]
    return spark.createDataFrame([(i, x, None, 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int, links int")


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "LEAST_BLOCK", 64)
    for table, cells in ((spark.read.parquet(f"{SF}/embeddings.parquet"), 256), (spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet"), 16), (odd_vectors(spark), 2)):
        monkeypatch.setattr(embedding_join, "CELL_VECTORS", cells)
        got = by_id(embedding_join.linked(table), "n_links", "component_id", "kept", key="vec_id")
        assert got == brute.linked_vectors([(r.vec_id, r.embedding) for r in table.collect()])
    assert embedding_join.linked(odd_vectors(spark).where("vec_id < 0")).count() == 0


@pytest.mark.parametrize("kind, dimensions, settings", [
    ("float", 8, {"CELL_VECTORS": 64, "LEAST_BLOCK": 256}),
    ("double", 8, {"CELL_VECTORS": 16, "LEAST_BLOCK": 64, "BLOCK_SHARE": 40}),
    ("float", 32, {"CELL_VECTORS": 64, "LEAST_BLOCK": 100, "MOST_BLOCK_VALUES": 1600, "TOGETHER": 37}),
    ("float", 3, {"CELL_VECTORS": 16, "MAX_PIVOTS": 3, "MOST_BLOCK_VALUES": 240}),  # cells larger than a block
])
def test_clusters_of_vectors(spark, monkeypatch, kind, dimensions, settings):
    import numpy as np

    for name, value in settings.items():
        monkeypatch.setattr(embedding_join, name, value)
    rng = np.random.default_rng(dimensions)
    centres = rng.normal(size=(60, dimensions))
    x = np.concatenate([c + 0.16 * np.sqrt((c @ c) / dimensions) * rng.normal(size=(n, dimensions)) for c, n in zip(centres, rng.integers(1, 60, 60), strict=True)])
    x = np.concatenate([x, rng.normal(size=(300, dimensions)), x[:40], np.repeat(x[:1], 200, axis=0), x[40:60] * 3]).astype(np.float32)
    rows = [(int(i) * 7 % 10007, v.tolist()) for i, v in enumerate(x)]
    got = by_id(embedding_join.linked(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")), "n_links", "component_id", "kept", key="vec_id")
    want = brute.linked_vectors(rows)
    assert got == want and sum(n > 0 for n, _, _ in want.values()) > 500
    own = embedding_join.members(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), "vec_id", "embedding")
    blocks = embedding_join.arranged(own, 0.95)[1].groupBy("block").count().count()
    assert blocks > 3


def test_rows_with_one_or_no_vector_id_stay(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.01])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id or -1, r.component_id or -1) for r in embedding_join.linked(table).collect()) == [(-1, -1), (1, 1), (1, 1), (2, 1)]


def test_word_bpe(documents, rows, empty):
    got = by_id(word_bpe.coded(documents, word_bpe.lexicon(documents), digests=True), "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == brute.encoded(rows, public_tokenizers.path("word_bpe_49k.json"))
    assert word_bpe.coded(empty, word_bpe.lexicon(empty)).count() == 0


def test_language_model(documents, rows, empty):
    from pyspark.sql import functions as F

    training = ~maxent.is_held_out(F.col("doc_id"))
    out = maxent.scored(documents, training)
    got, want = by_id(out, "n_tokens", "n_known", "train_tokens", "base_score", "score"), brute.base_scores(rows)
    assert {i: g[:3] for i, g in got.items()} == {i: w[:3] for i, w in want.items()}
    assert all(abs(got[i][3] - want[i][3]) <= 1e-6 * abs(want[i][3]) for i in want)
    test = [i for i in want if brute.fold(i) == 1 and i < 1000]
    assert sum(got[i][4] for i in test) > sum(got[i][3] for i in test)
    assert maxent.scored(empty, training).count() == 0
    assert maxent.scored(documents.where("doc_id = 1001"), F.lit(False)).count() == 1


def test_scores_do_not_depend_on_the_cluster(spark, documents):
    from pyspark.sql import functions as F

    training = ~maxent.is_held_out(F.col("doc_id"))
    one, two = (by_id(maxent.scored(documents.repartition(n), training), "score") for n in (2, 7))
    assert one.keys() == two.keys() and all(abs(one[i][0] - two[i][0]) <= 1e-9 * abs(one[i][0]) for i in one)


@pytest.mark.parametrize("size", [0, 1, 2, 15, 16, 17, 300])
def test_choices_on_all_ways_make_probabilities(size):
    import numpy as np

    rng = np.random.default_rng(size)
    count = np.sort(rng.integers(1, 1000, size))[::-1]
    hashes = maxent.mixed(np.arange(1, size + 1, dtype=np.uint64))
    order = np.argsort(hashes)
    v = maxent.Vocabulary(hashes[order], order, count, int(count.sum()) + 5, size + 3)
    weights = rng.normal(size=(3, v.rows, maxent.WIDTH)).astype(np.float32)
    total = 0.0
    for rank in range(size + 1):  # each word after the same two
        token = np.array([7, 8, hashes[rank] if rank < size else 9], np.uint64)
        rows, node, child, at = maxent.decisions(v, token, np.array([size, size, rank]), np.array([0, 3]))
        mine = at == 2
        if mine.any():
            logs = maxent._scores(weights, v.prior, rows[:, mine], node[mine])
            total += math.exp(sum(logs[np.arange(len(logs)), child[mine]] - np.log(np.exp(logs).sum(axis=1))))
        else:
            total += 1
    assert abs(total - 1) < 1e-4
    if size == 300:
        depth = np.diff(v.begins)[:size]
        assert (np.diff(depth) >= 0).all() and len(v.prior) == -(-size // (maxent.WIDTH - 1))


def test_personal_data(documents, rows, empty):
    got = by_id(personal_data.found(documents), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    for i, text in rows:
        base = brute.personal_data(text)
        assert got[i][:4] == tuple(sum(s[2] == k for s in base) for k in brute.KINDS), (i, base)
        assert got[i][4] == hashlib.sha256(brute.listed(base).encode()).hexdigest()
        mine = got[i][5].split(",") if got[i][5] else []
        assert {s for s in brute.listed(base).split(",") if s} <= set(mine)
        assert all(0 <= int(s.split(":")[1]) < int(s.split(":")[2]) <= len(text) for s in mine)
    assert len(got) == len(rows) and personal_data.found(empty).count() == 0


def test_contexts_discover_what_no_fixed_pattern_knows(spark):
    lines = [f"please write to contact user{i}@example.org for help" for i in range(30)] + ["please write to contact agent7.example for help", "there were 12 people and 7 dogs"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = by_id(personal_data.found(docs), "spans")
    assert found[30] == ("email:24:38",) and found[31] == ("",)
    assert by_id(personal_data.masked(docs), "text")[30] == ("please write to contact <email> for help",)


def test_masking_keeps_rows_and_other_columns(awkward, empty):
    out = personal_data.masked(awkward)
    assert out.columns == awkward.columns and out.count() == len(AWKWARD)
    texts = by_id(out, "text", "_row")
    assert texts[1000] == (None, "x") and texts[1001] == ("", "x") and texts[1014] == ("😀 mail 😀 <email> 😀", "x")
    assert personal_data.masked(empty).count() == 0


def test_language_is_that_of_the_fewest_bytes(spark):
    import zstandard

    samples = {"b": ("der die das und nicht mit sich auf " * 3).encode(), "a": ("the and of not with itself upon a " * 3).encode(), "c": b""}
    texts = ["The AND of not with", "der Hund und die Katze " * 300, "the der and die", "zzz qqq", "zz " * 2000, "12 34", "", None, "É", "\x00a"]
    settings = zstandard.ZstdCompressionParameters.from_level(language_id.LEVEL, min_match=language_id.MIN_MATCH, strategy=language_id.STRATEGY, write_content_size=False, write_checksum=False, write_dict_id=False)
    want = [brute.smallest(t, samples, settings, language_id.SEGMENT_BYTES, language_id.NARROW) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(language_id.identified(docs, samples), "lang_pred", "score", "rejected")
    assert [got[i] for i in range(len(texts))] == want
    assert {w[0] for w in want} >= {"a", "b", "und"} and {w[2] for w in want} == {True, False}
    tied = language_id.identified(docs.where("doc_id = 0"), {"y": samples["a"], "x": samples["a"]}).first()
    assert (tied.lang_pred, tied.score, tied.rejected) == ("x", 0.0, True)  # of equal sizes the first by name, rejected


def test_language(spark, documents, awkward, empty):
    out = QUERIES["op5_language_id"](spark, f"{DATA}/sf0.01")
    truth = by_id(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"), "lang")
    held = [r for r in out.collect() if r.held_out and truth[r.doc_id][0] is not None]
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in held) >= 0.97 * len(held)
    samples = language_id.dictionaries(documents.where("doc_id < 1000"))
    odd = by_id(language_id.identified(awkward, samples), "lang_pred", "score", "_row")
    assert odd[1000] == odd[1001] == odd[1002] == odd[1015] == ("und", 0.0, "x") and all(0 <= x[1] <= 1 for x in odd.values())
    assert language_id.identified(empty, samples).count() == 0
    assert {r.lang_pred for r in language_id.identified(awkward, language_id.dictionaries(empty)).collect()} == {"und"}


def test_packing(documents, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.TOKENIZER)
    t.no_truncation()
    out = packing.packed(documents).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for i, text in rows:
        ids, at = [*t.encode(text or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(pieces.pop(i), key=lambda r: r.start):
            own = ids[r.start : r.start + r.length]
            assert (r.start, r.doc_tokens, len(own)) == (at, len(ids), r.length) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
            at += r.length
        assert at == len(ids)
    assert not pieces
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    tokens = sum(r.length for r in out)
    assert len(windows) <= 1.02 * tokens / packing.WINDOW + 1
    assert packing.packed(empty).count() == 0


def test_words_with_one_hash_are_told_apart(monkeypatch):
    import numpy as np
    from tidewell.llm import arrays, byte_bpe

    texts = [" ".join(f"{w}{i}" for i in range(300)) for w in ("one", "two")] + ["one1 two1 one1"]
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    plain = byte_bpe.ByteLevelEncoder(packing.TOKENIZER)
    want = [plain.encode(d, np.array([0, len(d)]))[0].tolist() for d in data]
    hashes = arrays.span_hashes
    for bits, seeds in ((1, 3), (9, 1)):  # all collide within a text at once; some between texts only
        weak = lambda d, a, b, seed=0: hashes(d, a, b, seed) & np.uint64((1 << bits) - 1) if seed < seeds else hashes(d, a, b, seed)  # noqa: B023, E731
        monkeypatch.setattr(arrays, "span_hashes", weak)
        encoder = byte_bpe.ByteLevelEncoder(packing.TOKENIZER)
        assert [encoder.encode(d, np.array([0, len(d)]))[0].tolist() for d in data] == want and encoder.seed
        starts, ends, _ = arrays.words(data[0], np.array([0, len(data[0])]))
        assert len(arrays.told_apart(data[0], starts, ends)[0]) == 300
    # the first chunk's words have different hashes, the second's are the same as some of them
    monkeypatch.setattr(arrays, "span_hashes", lambda d, a, b, seed=0: (b - a).astype(np.uint64) if seed == 0 else hashes(d, a, b, seed))
    encoder, two = byte_bpe.ByteLevelEncoder(packing.TOKENIZER), [np.frombuffer(x, np.uint8) for x in (b"abc", b"xyz")]
    assert [encoder.encode(d, np.array([0, 3]))[0].tolist() for d in two] == [plain.encode(d, np.array([0, 3]))[0].tolist() for d in two] and encoder.seed == 1


def test_equal_pieces_are_dealt_over_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 100)
    out = packing.packed(spark.createDataFrame([(1, "one text")] * 1000, "doc_id long, text string")).collect()
    assert len(out) == 1000 and len({r.sequence_id >> 40 for r in out}) > 5


def test_best_fit_takes_the_tightest_window():
    import random

    rng = random.Random(5)
    lengths = sorted((rng.randint(1, 64) for _ in range(500)), reverse=True)
    at, offsets = packing.best_fit(lengths, 64)
    room, mine = [], []
    for n in lengths:
        fits = [r for r in room if r >= n]
        if fits:
            room[room.index(min(fits))] -= n
        else:
            room.append(64 - n)
    used = defaultdict(int)
    for n, w, o in zip(lengths, at, offsets, strict=True):
        assert used[w] == o
        used[w] += n
        mine.append(w)
    assert sorted(64 - u for u in used.values()) == sorted(room)


def test_audio(spark, documents, rows, empty):
    files = mpeg_audio.stored(documents)
    back = by_id(mpeg_audio.probed(files), "n_bytes", "payload", "bad_checksums", "skipped_bytes", "duration_ms")
    for i, text in rows:
        data = (text or "").encode()
        n, payload, bad, skipped, _ = back[i]
        assert (n, payload, bad, skipped) == (len(data), data.ljust(max(64, -(-len(data) // 64) * 64), b"\0"), 0, 0)
    assert mpeg_audio.stored(empty).count() == 0
    q = {r.doc_id: r for r in QUERIES["op7_mpeg_audio"](spark, SF).collect()}
    for i, text in rows:
        if i in q:
            data = (text or "").encode()
            payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
            assert (q[i].payload_bytes, q[i].payload_sha256, q[i].tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_audio_is_found_again_after_noise_and_damage():
    data = mpeg_audio.build(bytes(range(256)) * 30, "title")
    whole = mpeg_audio.parse(data)
    assert whole.tags["TIT2"] == "title" and whole.table == "Xing" and whole.table_frames == len(whole.offsets) and whole.milliseconds == len(whole.offsets) * 36
    at = whole.offsets[2]
    noisy = mpeg_audio.parse(data[:at] + b"\xff\xfa noise \xff" + data[at:] + b"TAG" + b"x" * 125)
    assert len(noisy.offsets) == len(whole.offsets) and noisy.skipped == 10
    damaged = bytearray(data)
    damaged[at + 10] ^= 1
    assert mpeg_audio.parse(bytes(damaged)).bad_checksums == 1
    for odd in (b"", b"\xff", b"ID3", b"\xff" * 500, data[:40]):
        assert mpeg_audio.parse(odd).offsets == []


def bit_crc(bits):
    """The checksum bit by bit."""
    value = 0xFFFF
    for b in bits:
        value = (value << 1 ^ (0x8005 if (value >> 15 ^ int(b)) & 1 else 0)) & 0xFFFF
    return value


def checked_frame(second, third, fourth, bits, tail="1" * 40):
    """A frame of zeros with a checksum over `bits`, other bits behind them."""
    head = bytes([0xFF, second, third, fourth])
    h = mpeg_audio.header(head)
    crc = bit_crc("".join(f"{b:08b}" for b in head[2:]) + bits)
    body = bits + tail
    return head + crc.to_bytes(2, "big") + int(body.ljust(-(-len(body) // 8) * 8, "0"), 2).to_bytes(-(-len(body) // 8), "big").ljust(h.length - 6, b"\0")


@pytest.mark.parametrize("second, third, fourth, bits", [
    (0xFE, 0x80, 0x00, "0110" * 64),  # layer I, two channels
    (0xFE, 0x80, 0x50, "0110" * (2 * 8 + 24)),  # layer I, channels share from subband 8 on
    (0xFE, 0x84, 0xC0, "0011" * 32),  # layer I, one channel
    (0xFC, 0x84, 0xC0, "0001" * 11 + "000" * 12 + "00" * 4 + "10" * 11),  # layer II, 48 kHz, one channel
    (0xFC, 0xA0, 0xC0, "0001" * 11 + "000" * 12 + "01" * 7 + "10" * 18),  # layer II, 44.1 kHz, 160 kilobits
    (0xFC, 0x10, 0xC0, "0001" * 2 + "001" * 6 + "11" * 8),  # layer II, 44.1 kHz, 32 kilobits
    (0xFC, 0x18, 0xC0, "0001" * 2 + "001" * 10 + "11" * 12),  # layer II, 32 kHz, 32 kilobits
    (0xFC, 0x80, 0x40, "0001" * 8 + "0001" * 7 + "000" * 12 + "00" * 4 + "10" * (8 + 14)),  # layer II, 128 kilobits, shared from subband 4 on
    (0xF4, 0x80, 0xC0, "0001" * 4 + "001" * 7 + "00" * 19 + "11" * 11),  # layer II of MPEG 2
    (0xF2, 0x80, 0xC0, "0" * 70 + "11"),  # layer III of MPEG 2, one channel
    (0xE2, 0x80, 0x00, "0" * 134 + "11"),  # layer III of MPEG 2.5
])
def test_checksums_of_all_layers(second, third, fourth, bits):
    frame = checked_frame(second, third, fourth, bits)
    audio = mpeg_audio.parse(frame * 4)
    assert (len(audio.offsets), audio.bad_checksums, audio.skipped, audio.samples) == (4, 0, 0, 4 * mpeg_audio.header(frame[:4]).samples)
    for at, bad in ((6, 1), (6 + (len(bits) - 1) // 8, 1), (6 + len(bits) // 8 + 2, 0)):
        damaged = bytearray(frame * 4)
        damaged[len(frame) + at] ^= 1 << (7 - (len(bits) - 1) % 8 if at > 6 and bad else 0)
        assert mpeg_audio.parse(bytes(damaged)).bad_checksums in ((1,) if bad else (0,)), at


def test_tags_and_tables_of_other_writers():
    frame = bytes([0xFF, 0xFB, 0x90, 0xC0]).ljust(417, b"\0")
    vbri = bytearray(frame)
    vbri[36:70] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 417 * 5, 4, 4, 2, 2, 1) + struct.pack(">4H", 100, 200, 300, 400)
    id3v23 = b"TIT2" + struct.pack(">I", 299) + b"\0\0\1" + "tïtle".encode("utf-16").ljust(298, b"\0")
    tags = b"ID3\3\0\0" + mpeg_audio._spread(len(id3v23) + 20) + id3v23 + bytes(20)
    id3v1 = b"TAG" + b"old".ljust(30, b"\0") + b"who".ljust(30) + b"album".ljust(65, b"\0")
    audio = mpeg_audio.parse(tags + bytes(vbri) + frame * 4 + id3v1)
    start = len(tags)
    assert audio.tags == {"TIT2": "tïtle", "TPE1": "who", "TALB": "album"}
    assert (audio.table, audio.table_frames, audio.seek) == ("VBRI", 4, [start + 417 + x for x in (0, 200, 600, 1200)])
    assert audio.offsets == [start + 417 * k for k in range(1, 5)] and (audio.samples, audio.rate, audio.milliseconds) == (4608, 44100, 104)
    slow = bytes([0xFF, 0xF3, 0x80, 0xC0]).ljust(208, b"\0") * 3
    assert [(a.samples, a.rate, len(a.offsets)) for a in [mpeg_audio.parse(slow)]] == [(3 * 576, 22050, 3)]


def test_no_bytes_make_audio_fail(spark):
    import random

    rng, whole = random.Random(11), mpeg_audio.build(bytes(range(256)) * 12, "title")
    frame = bytes([0xFF, 0xFB, 0x90, 0xC0]).ljust(417, b"\0")
    files = [None, b""]
    for value in ("abc", "9" * 5000, "-5", "", "12\0", "٣"):
        text = b"\3payload\0" + value.encode()
        files.append(b"ID3\4\0\0" + mpeg_audio._spread(len(text) + 10) + b"TXXX" + mpeg_audio._spread(len(text)) + b"\0\0" + text + frame * 3)
    files.append(frame[:36] + b"VBRI" + b"\xff" * 300 + frame * 3)
    for _ in range(3000):
        data = bytearray(whole if rng.random() < 0.7 else rng.randbytes(500))
        for _ in range(rng.randrange(1, 30)):
            at = rng.randrange(min(len(data), rng.choice((60, 300, 10_000))))
            data[at : at + rng.randrange(3)] = rng.choice((rng.randbytes(2), b"\xff\xfb", b"\xff", b"TAG", b""))
        files.append(bytes(data[: rng.randrange(len(data) + 1)] if rng.random() < 0.2 else data))
    table = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "doc_id long, media binary")
    found = {r.doc_id: r for r in mpeg_audio.probed(table).collect()}
    assert len(found) == len(files) and found[0].payload == b"" and not found[0].frame_offsets
    assert [len(found[i].payload) for i in range(2, 8)] == [1188, 1188, 1188, 1188, 12, 1188]


def test_audio_with_a_tag_inside_the_last_frame():
    payload = b"x" * 1289 + b"TAG" + b"y" * 116
    data, tag = mpeg_audio.build(payload), b"TAG" + b"title".ljust(125, b"\0")
    assert data[-128:-125] == b"TAG"
    for more, title in ((b"", None), (tag, "title")):
        audio = mpeg_audio.parse(data + more)
        assert (mpeg_audio.payload_of(data, audio), audio.skipped, audio.tags.get("TIT2")) == (payload, 0, title)
    assert mpeg_audio.parse(data[:-10] + tag).tags["TIT2"] == "title"


def test_piece_counts(documents, rows, empty):
    pieces = token_counts.vocabulary()
    longest, seen = max(map(len, pieces)), {}
    got = by_id(token_counts.counted(documents), "n_words", "n_tokens")
    for i, text in rows:
        own = [w.encode() for w in brute.WORD.findall(text or "")]
        for w in own:
            if w not in seen:
                seen[w] = brute.piece_count(w, pieces, longest)
        assert got[i] == (len(own), sum(seen[w] for w in own)), i
    assert len(got) == len(rows) and token_counts.counted(empty).count() == 0


def test_near_copies(spark, documents, rows, empty):
    assert by_id(shingle_join.classes(documents), "n", "component", key="_doc") == brute.near_copies(rows)
    whole = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()]
    assert by_id(QUERIES["op9_shingle_join"](spark, f"{DATA}/sf0.01"), "n_shingles", "component_id") == brute.near_copies(whole)
    assert shingle_join.classes(empty).count() == 0


def test_large_groups_are_split_without_losing_links(spark, monkeypatch):
    import random

    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    texts = []
    for _ in range(150):
        w = base.copy()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"x{rng.randrange(50)}"
        texts.append(" ".join(w))
    rows = [*enumerate(texts), (999, "  "), (998, None)]
    monkeypatch.setattr(shingle_join, "PIVOTS", 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size, percent, shingles, members in ((4, 85, 700, 256), (5, 80, 700, 10), (4, 85, 1 << 20, 20)):
        monkeypatch.setattr(shingle_join, "BLOCK_SHINGLES", shingles)
        monkeypatch.setattr(shingle_join, "GROUP_MEMBERS", members)
        assert by_id(shingle_join.classes(docs, size=size, percent=percent), "n", "component", key="_doc") == brute.near_copies(rows, size, percent)


def test_near_copies_of_a_copied_text_stay_out_of_other_blocks(spark, monkeypatch):
    import random

    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base)) for i in range(500, 503)]
    for i in range(80):  # two places changed: linked with the text, hardly with one another
        w = base.copy()
        for k in (0, 100):
            w[k + rng.randrange(90)] = f"x{i}-{k}"
        rows.append((i, " ".join(w)))
    visitors, searched = [], shingle_join._searched
    monkeypatch.setattr(shingle_join, "_searched", lambda blocks, percent: visitors.append(blocks.where("visitor = 1").count()) or searched(blocks, percent))
    monkeypatch.setattr(shingle_join, "PIVOTS", 0)
    monkeypatch.setattr(shingle_join, "GROUP_MEMBERS", 10)
    got = by_id(shingle_join.classes(spark.createDataFrame(rows, "doc_id long, text string")), "n", "component", key="_doc")
    assert got == brute.near_copies(rows) and {c for _, c in got.values()} == {0}
    assert len(visitors) == 2 and visitors[0] > 0 == visitors[1]


def test_search_finds_one_member_of_each_linked_component(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(np.where(rng.random(60) < 0.06, rng.integers(1000, 1200, 60), np.arange(60))).astype(np.uint64) for _ in range(90)]
    sets += [np.unique(rng.integers(0, 60, 50)).astype(np.uint64) for _ in range(10)]
    labels = rng.integers(0, 40, 80).tolist()

    def linked(x, y):
        k = len(np.intersect1d(x, y))
        return 100 * k >= 85 * (len(x) + len(y) - k)

    for probe in (0, shingle_join.PROBE, 1 << 40):
        monkeypatch.setattr(shingle_join, "PROBE", probe)
        block = shingle_join.Block(sets[:80], labels)
        for q, s in enumerate(sets):
            own = labels[q] if q < 80 else -1
            found = block.search(s, own)
            assert sorted(labels[d] for d in found) == sorted({x for d, x in enumerate(labels) if x != own and linked(s, sets[d])})
            assert all(linked(s, sets[d]) for d in found)


def test_rows_with_one_key_and_size_keep_their_own_links(spark):
    one, two = ([f"{k}{i}" for i in range(60)] for k in "ab")
    rows = [(1, one), (1, two), (2, [*one[:-1], "x"]), (3, [*two[:-1], "y"])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert {(r["_doc"], r.component) for r in shingle_join.classes(docs).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_keys_with_two_texts_have_the_links_of_both(spark):
    import random

    rng, rows = random.Random(8), []
    for i in range(60):
        for k in range(2):
            w = [f"w{rng.randrange(5000)}" for _ in range(80)]
            rows += [(i, " ".join(w)), (100 + 2 * i + k, " ".join([*w[:-1], "end"]))]
    got = {r["_doc"]: r.component for r in shingle_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i if i < 100 else (i - 100) // 2 for i, _ in rows}


@pytest.mark.parametrize("name", ORACLE)
def test_operators_agree_with_sql(spark, name):
    got, want = compared(name, spark)
    assert got == want


def test_lines_of_awkward_rows(awkward, empty):
    out = line_dedup.cleaned(awkward, sites=2)
    assert out.columns == awkward.columns
    texts = by_id(out, "text")
    assert texts[1000] == (None,) and texts[1001] == ("",) and len(texts) == len(AWKWARD)
    assert line_dedup.cleaned(empty).count() == 0


def test_lines_are_counted_by_site_not_by_row(spark):
    rows = [(i, f"own {i} text of this page only\n shared \nend {i}", f"s{i % 4}") for i in range(40)] + [(100 + i, f"mine {i} and more of it\nlocal\nlast {i}", "one") for i in range(40)]
    out = by_id(line_dedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string, source string"), sites=4), "text")
    assert out[3] == ("own 3 text of this page only\nend 3",) and out[103] == ("mine 3 and more of it\nlocal\nlast 3",)


def test_lines_go_from_documents_that_are_mostly_shared_lines(spark):
    rows = [(i, f"own {i}\n{'shared by all ' * 9}\nend {i}", f"s{i}") for i in range(4)] + [(9, f"{'shared by all ' * 9}\n \t \n{'shared by all ' * 9}", "s0")]
    out = by_id(line_dedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string, source string"), sites=4, counts=True), "text", "n_boilerplate", "kept_whole")
    assert [out[i] for i in range(4)] == [(f"own {i}\nend {i}", 1, False) for i in range(4)]
    assert out[9] == (rows[4][1], 2, True)


def test_documents_with_null_or_repeated_ids_stay_in_the_pipeline(spark):
    import corpus_pipeline

    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcd"}
    rows = [(None, text["a"]), (None, text["b"]), (None, text["b"]), (7, text["c"]), (7, text["d"]), (8, text["d"] + " end"), (None, text["c"] + " end")]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(((r.doc_id or 0), r.text) for r in out.collect()) == [(0, text["a"]), (0, text["b"]), (7, text["c"]), (7, text["d"])]


def test_pipeline(spark):
    import corpus_pipeline

    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
            out = spark.createDataFrame(out.collect(), docs.schema)
        seen[name], docs = out, out
    near = [(r.doc_id, r.text) for r in seen["line_dedup"].collect()]
    heads = {c for _, c in brute.near_copies(near, 5, 80).values()}
    assert {r.doc_id for r in seen["near_duplicates"].collect()} == heads
    assert {r.doc_id for r in seen["packing"].collect()} == heads
    assert not any(brute.personal_data(r.text) for r in seen["personal_data"].collect())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, seen["language"].where("false"), SF).count() == 0


def test_base_of_the_language_model_comes_without_training(spark, monkeypatch):
    monkeypatch.setattr(maxent, "trained", lambda *_: pytest.fail("the base columns don't need the model"))
    got, want = compared("language_model_base", spark)
    assert got == want
