import random
import struct

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.llm import bpe, chat, counts, media
from orrery.llm.queries import EDITS

C = bpe.codec(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken")


def test_masks_are_those_of_a_byte_by_byte_check(spark):
    turns = [(1, 0, "user", "Héllo there"), (1, 1, "assistant", "Ja, größer 😀 ok"), (1, 2, "user", None), (1, 2, "assistant", ""), (2, 0, None, "x"), (2, 0, None, "x"), (None, None, "assistant", "y")]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, loss_mask string")
    rows = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert rows[1].n_turns == 4 and rows[2].n_turns == 2 and rows[2].n_learnt == 0 and rows[None].n_learnt > 0
    ordered = [dict(role=r, text=x) for r, x in (("user", "Héllo there"), ("assistant", "Ja, größer 😀 ok"), ("assistant", ""), ("user", None))]
    text, starts, ends = chat.render(ordered)
    raw = text.encode()
    flags = np.zeros(len(raw), bool)
    for s, e in zip(starts, ends):
        flags[s:e] = True
    at, want = 0, []
    for t in rows[1].input_ids:
        n = len(C.bytes_of[t])
        want.append(int(flags[at : at + n].any()))
        at += n
    assert at == len(raw) and rows[1].loss_mask == want and sum(want) == rows[1].n_learnt
    assert chat.format_chats(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text("ab  c.\n1é'", max_size=300), st.lists(st.tuples(st.integers(0, 320), st.integers(0, 40), st.text("xy 9\n", max_size=60)), max_size=5))
def test_edited_counts_are_those_of_encoding_again(text, edits):
    tree = counts.Tree(text, C.encode, 16)
    assert tree.total == len(C.encode(text))
    for at, n, new in edits:
        a = min(at, len(text))
        text = text[:a] + new + text[min(a + n, len(text)) :]
        tree.edit(at, at + n, new)
        assert tree.text == text and tree.total == len(C.encode(text)) and tree.chars[1] == len(text)


def test_an_edit_of_a_long_text_reads_little_of_it():
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(20_000))
    tree = counts.Tree(text, C.encode)
    tree.encoded = 0
    tree.edit(70_000, 70_010, "something else")
    assert tree.encoded < 2_000 and tree.total == len(C.encode(tree.text))


def test_counts_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "s"), (3, "some words here and there", "s"), (3, "some words here and there", "s")], "doc_id long, text string, source string").withColumn("edits", F.lit("clash"))
    rows = sorted(counts.count_edited(df, F.expr(EDITS)).collect(), key=lambda r: r.doc_id)
    t = "some words here and there"
    edited = "s: " + t
    middle = len(t) // 2
    edited = edited[:middle] + " revised text" + edited[middle + 8 :]
    assert (rows[2].n_tokens, rows[2].n_tokens_edited) == (len(C.encode(t)), len(C.encode(edited))) and rows[2] == rows[3]
    assert rows[0].n_tokens == rows[1].n_tokens == 0
    assert counts.count_edited(df, F.lit(None).cast("array<struct<at:int,until:int,new:string>>")).where("n_tokens <> n_tokens_edited").count() == 0


def test_trees_are_kept_and_taken_up_again(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "beta's", "42", "née", "x" * 30]) for _ in range(n)) for n in (0, 3, 400, 2000)] + [None, "y" * 5000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(2, texts[2], "clash"), (None, texts[1], "clash")], "doc_id long, text string, leaves string")
    counts.plant(df).write.parquet(str(tmp_path / "trees"))
    what = "array(struct(10 AS at, 14 AS until, ' new words' AS new), struct(5 AS at, 2 AS until, '<>' AS new), struct(100000 AS at, 100001 AS until, ' end' AS new))"
    want = [t or "" for t in texts]
    path = str(tmp_path / "trees")
    for round_ in range(3):
        # Each round is a run of its own: it reads the trees that the last one wrote.
        counts.edit(spark.read.parquet(path), F.expr(what)).write.parquet(path := str(tmp_path / f"trees{round_}"))
        rows = [r for r in spark.read.parquet(path).collect() if r.doc_id is not None]
        before, want = want, []
        for t in before:
            for a, b, new in ((10, 14, " new words"), (5, 2, "<>"), (100000, 100001, " end")):
                a = min(a, len(t))
                t = t[:a] + new + t[min(max(b, a), len(t)) :]
            want.append(t)
        assert len(rows) == len(texts) + 1
        for r in rows:
            assert r.text == want[r.doc_id] and r.n_tokens == len(C.encode(r.text)) == sum(x.tokens for x in r.leaves) and r.n_tokens_before == len(C.encode(before[r.doc_id]))
            assert r.doc_id != 3 or r.n_chars_encoded < len(r.text) / 3


def test_shots_of_made_films_are_found(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(200, 64))
    content, begins = media.film(vectors)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(500, None), (0, vectors[0].tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in media.clips(media.films(df)).collect():
        assert r.error is None and r.start_s == round(r.first_frame / 12, 6)
        got.setdefault(r.media_id, []).append(r.first_frame)
    # The row that comes twice has its clips twice; nearly all films have just the cuts that they were made with.
    assert sorted(got.pop(0)) == sorted(2 * [r[2] for r in media.clips_of(content[:1])])
    assert set(got) == set(range(1, 200)) and sum(sorted(v) == begins[i] for i, v in got.items()) >= 0.95 * len(got)
    # In restless films every frame is over the least difference, so that alone would cut everywhere.
    d = [media.differences(np.array(media.histograms([x[a : a + n] for a, n in media.parse_avi(x)[0]]))) for x in content[:60]]
    assert sum((x > media.LEAST).mean() > 0.9 for x in d) > 15
    assert media.clips(media.films(df.limit(0))).count() == 0


def boxed(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def test_jpeg_and_avi_parts():
    img = np.clip(np.add.outer(np.arange(40) * 3, np.arange(56) * 2).astype(float), 0, 255)
    assert np.abs(media.decode_jpeg(media.encode_jpeg(img, 2))[0].astype(float) - img).max() < 4
    frames = [media.encode_jpeg(np.full((16, 16), v)) for v in (20, 20, 200, 200)]
    avi = media.write_avi(frames, 16, 16, 10)
    walked = avi.replace(b"idx1", b"junk")
    assert media.parse_avi(avi)[0] == media.parse_avi(walked)[0]
    cut = lambda data: [c[2:6] for c in media.clips_of([data])]
    assert cut(avi) == [(0, 2, 0.0, 0.2), (2, 2, 0.2, 0.4)]
    bare = [f[: f.index(b"\xff\xc4")] + f[f.index(b"\xff\xda") :] for f in frames]
    assert cut(media.write_avi(bare, 16, 16, 10)) == cut(avi)
    for bad in (b"\xff\xd8broken", b"", frames[0][:-6] + b"\xff\xd9"):
        # A frame that fails repeats the last one, at the start the next one; a dropped frame has no bytes, but its time.
        assert cut(media.write_avi([*frames[:1], bad, *frames[1:]], 16, 16, 10)) == [(0, 3, 0.0, 0.3), (3, 2, 0.3, 0.5)]
        assert cut(media.write_avi([bad, *frames], 16, 16, 10)) == [(0, 3, 0.0, 0.3), (3, 2, 0.3, 0.5)]
    assert cut(media.write_avi([b"xx", b"yy"], 16, 16, 10)) == [(0, 2, 0.0, 0.2)]


def test_all_parts_of_an_open_file_are_read():
    frames = [media.encode_jpeg(np.full((16, 16), v)) for v in (20, 20, 200, 200, 20, 20, 20, 20)]
    first = media.write_avi(frames[:4], 16, 16, 10)
    more = boxed(b"RIFF", b"AVIX" + boxed(b"LIST", b"movi" + b"".join(boxed(b"00dc", f) for f in frames[4:])))
    assert [c[2:4] for c in media.clips_of([first + more])] == [(0, 2), (2, 2), (4, 4)]
    # An index of chunks alone, in a file whose chunks a walk can't see.
    hidden, at, entries = b"", len(first) + 8, b""
    for f in frames[4:]:
        entries += struct.pack("<II", len(hidden) + 8, len(f))
        hidden += boxed(b"00dc", f)
    index = struct.pack("<HBBI4sQI", 2, 0, 1, 4, b"00dc", at, 0) + entries
    whole = first + boxed(b"JUNK", hidden) + boxed(b"ix00", index)
    assert [c[2:4] for c in media.clips_of([whole])] == [(0, 2), (2, 2), (4, 4)]
    # Half of an index: the other chunks count all the same.
    half = first[: first.index(b"idx1")]
    half += boxed(b"idx1", first[first.index(b"idx1") + 8 :][:32])
    assert media.parse_avi(half)[0] == media.parse_avi(first)[0]


def test_colour_pictures_of_another_encoder(spark):
    jvm = spark.sparkContext._jvm
    wide, high = 52, 44
    y, x = np.mgrid[0:high, 0:wide]
    rgb = np.stack([x * 4, y * 5, 255 - x * 2 - y * 2], axis=2).clip(0, 255).astype(int)
    image = jvm.java.awt.image.BufferedImage(wide, high, 1)
    for j in range(high):
        for i in range(wide):
            r, g, b = rgb[j, i].tolist()
            image.setRGB(i, j, (r << 16) | (g << 8) | b)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    data = bytes(out.toByteArray())
    planes = media.decode_jpeg(data)
    r, g, b = rgb.transpose(2, 0, 1).astype(float)
    light = 0.299 * r + 0.587 * g + 0.114 * b
    blue, red = 128 + (b - light) * 0.564, 128 + (r - light) * 0.713
    assert len(planes) == 3 and planes[0].shape == (high, wide) and planes[1].shape == (high // 2, wide // 2)
    assert np.abs(planes[0] - light).mean() < 3
    for plane, want in ((planes[1], blue), (planes[2], red)):
        assert np.abs(plane - want.reshape(high // 2, 2, wide // 2, 2).mean(axis=(1, 3))).mean() < 3
    h = media.histograms([data])[0]
    assert len(h) == 64 and abs(h.sum() - 1) < 1e-9
    assert np.allclose(h[:32] * 3, np.bincount(planes[0].ravel() >> 3, minlength=32) / planes[0].size)


def flat_jpeg(levels, wide, high, restart, scans_of, deep):
    """A JPEG of flat blocks, written bit by bit: levels by part, restart intervals, one scan for each list of parts, 16-bit tables."""
    codes, code, k = {}, 0, 0
    counts, symbols = media.TABLES[0, 0]
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            codes[symbols[k]] = format(code, f"0{n}b")
            code, k = code + 1, k + 1
        code <<= 1
    end = "1010"
    segment = lambda mark, body: bytes([255, mark]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + segment(0xDB, bytes([deep << 4]) + (struct.pack(">64H", *[8] * 64) if deep else bytes([8]) * 64))
    out += segment(0xC0, struct.pack(">BHHB", 8, high, wide, len(levels)) + b"".join(bytes([i + 1, 0x11, 0]) for i in range(len(levels))))
    out += segment(0xDD, struct.pack(">H", restart)) if restart else b""
    for parts in scans_of:
        out += segment(0xDA, bytes([len(parts)]) + b"".join(bytes([i + 1, 0]) for i in parts) + bytes([0, 63, 0]))
        bits, last = "", dict.fromkeys(parts, 0)

        def packed(bits):
            bits += "1" * (-len(bits) % 8)
            return int(bits or "0", 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")

        for unit in range(len(levels[0])):
            if restart and unit and unit % restart == 0:
                out += packed(bits) + bytes([255, 0xD0 + (unit // restart - 1) % 8])
                bits, last = "", dict.fromkeys(parts, 0)
            for i in parts:
                v = int(levels[i][unit]) - 128
                d = v - last[i]
                last[i] = v
                n = abs(d).bit_length()
                bits += codes[n] + (format(d if d > 0 else d + (1 << n) - 1, f"0{n}b") if n else "") + end
        out += packed(bits)
    return out + b"\xff\xd9"


def test_restarts_scans_of_single_parts_and_deep_tables():
    rng = np.random.default_rng(4)
    levels = rng.integers(0, 256, (3, 12))
    want = [np.kron(x.reshape(3, 4), np.ones((8, 8))) for x in levels]
    # Annex K's tables of brightness serve all parts, as tables 0.
    for restart in (0, 1, 5, 12):
        for scans_of in ([[0, 1, 2]], [[0], [1], [2]], [[0], [1, 2]]):
            for deep in (0, 1):
                data = flat_jpeg(levels, 32, 24, restart, scans_of, deep)
                assert all((a == b).all() for a, b in zip(media.decode_jpeg(data), want)), (restart, scans_of, deep)
                assert np.allclose(media.histograms([b"", data, data])[2], media.histograms([data])[0])


def test_bad_media_give_an_error_row(spark):
    rows = [(1, None), (2, b""), (3, b"RIFF"), (4, b"RIFF" + struct.pack("<I", 4) + b"AVI "), (5, media.write_avi([media.encode_jpeg(np.zeros((8, 8)))], 8, 8, 5))]
    df = spark.createDataFrame(rows, "media_id long, content binary").withColumn("error", F.lit("clash"))
    got = {r.media_id: r for r in media.clips(df).collect()}
    assert set(got) == {3, 4, 5} and got[3].error and got[4].error and got[5].error is None and got[5].n_frames == 1
