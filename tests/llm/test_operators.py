"""Each operator against a brute-force version on a small fixture with nulls, empty and long texts,
ties, repeated rows, empty tables and columns with clashing names."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from libgauge.llm import chat, licenses, mixing, mpeg_audio, ngram_join, packing, quality_classifier, quality_rules, sharding, suffix_dedup
from libgauge.llm.tokens import count_tokens, encoder

#: Names that operators use inside.
CLASHES = ("shard", "chunk", "node", "root", "tokens", "kept", "carried", "score", "quality_score", "slot", "row", "rid", "times", "copy", "drawn", "__row", "__rid", "__times", "__tokens", "__copy")


def words_of(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    rng = random.Random(5)
    passage = words_of(rng, 70)
    texts = [words_of(rng, rng.randrange(1, 160)) for _ in range(40)]
    texts += [texts[0], texts[0], texts[3]]
    for k in (1, 5, 7):  # near copies
        w = texts[k].split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [words_of(rng, 30) + " " + passage + " " + words_of(rng, 20) for _ in range(4)]
    texts += ["é" * 150 + passage, "ü" * 399, "a" * 450, None, "", " \n\t ", "one", "Two Words", "two\twords", "x " * 300, words_of(rng, 6000, 50)]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.when(F.col("doc_id") < 45, "big").when(F.col("doc_id") < 60, F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string"))))
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3, "doc_id").cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def utf8(t):
    return (t or "").encode()


def test_mpeg(docs, nothing):
    rows = mpeg_audio.probe_media(mpeg_audio.store_texts(docs)).collect()
    text = dict(corpus())
    for r in rows:
        b = utf8(text[r.doc_id])
        assert bytes(r.payload) == mpeg_audio.padded(b) and r.n_bytes == len(b) and len(r.payload) % 64 == 0 < len(r.payload)
        assert r.duration_us == r.frames * 24000 and '"crc_bad":0' in r.feature and '"music_ok":true' in r.feature
    assert len(rows) == len(text) and mpeg_audio.probe_media(mpeg_audio.store_texts(nothing)).count() == 0


def test_mpeg_streams():
    media = mpeg_audio.store_payload(random.Random(1).randbytes(5000))
    cut = mpeg_audio.probe(media)["seek_offsets"][0] + 960
    x = mpeg_audio.probe(media[:cut] + b"junk\xff\xfb\x90" + media[cut:])
    assert (x["resyncs"], x["frames"], x["skipped"]) == (1, 6, 7)
    broken = bytearray(media)
    broken[cut + 10] ^= 1
    assert mpeg_audio.probe(bytes(broken))["crc_bad"] == 1
    broken = bytearray(media)
    broken[cut + 100] ^= 1
    assert not mpeg_audio.probe(bytes(broken))["vbr"]["music_ok"]
    assert mpeg_audio.probe(b"")["frames"] == 0 and mpeg_audio.probe(b"\xff" * 50)["frames"] == 0
    slow = 0
    for b in media[:300]:
        slow ^= b
        for _ in range(8):
            slow = slow >> 1 ^ (0xA001 if slow & 1 else 0)
    assert mpeg_audio.music_crc(media[:300]) == slow
    data = bytes((0xFF, 0xFB, 0x90, 0)) + bytes(413)  # 128 kbit/s, 44.1 kHz, no CRC
    assert mpeg_audio.probe(data * 3) | {"payload": b""} == mpeg_audio.probe(data * 3) | {"payload": b""} and mpeg_audio.probe(data * 3)["duration_us"] == 3 * 1152 * 1_000_000 // 44100


def test_sharding(spark, docs, nothing):
    rows = sharding.assign(docs, shards=5, slots=64).collect()
    text = dict(corpus())
    loads, places = Counter(), defaultdict(list)
    for r in rows:
        b = utf8(text[r.doc_id])
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(b) + 8, zlib.crc32(b), "bytes", None)
        loads[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and len(rows) == len(text)
    slots = Counter()
    for r in rows:
        slots[r.virtual_slot] += r["size"]
    assert max(loads.values()) <= max(sum(loads.values()) / 5 * 1.1, max(slots.values()))
    assert sharding.assign(nothing).count() == 0


def test_slot_map_edits(spark):
    sums = spark.createDataFrame([(0, 100, 1), (4, 90, 1), (1, 10, 1)], "virtual_slot int, bytes long, rows long")
    zero = sharding.first_map(spark, 4, 16)
    edits = sharding.rebalance(zero, sums, 4, 1)
    assert edits.count() < 16 and {r.version for r in edits.collect()} <= {1}
    now = sharding.current_map(zero.unionByName(edits))
    loads = now.join(sums, "virtual_slot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()
    assert now.count() == 16 and max(r.b for r in loads) == 100
    assert sharding.current_map(zero.unionByName(edits), 0).filter("shard != virtual_slot % 4").count() == 0
    grown = sharding.current_map(zero.unionByName(sharding.rebalance(zero, sums, 5, 1)))
    assert grown.count() == 16


def test_suffix_dedup(docs, nothing):
    rows = corpus()
    seen = Counter()
    for _, t in rows:
        b = utf8(t)
        seen.update(b[k : k + 200] for k in range(len(b) - 199))
    got = {r.doc_id: r for r in suffix_dedup.dedup(docs).collect()}
    for i, t in rows:
        b = utf8(t)
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        r = got[i]
        assert (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), i
    assert sum(r.n_removed > 0 for r in got.values()) > 10 and suffix_dedup.dedup(nothing).count() == 0


def test_suffix_text(docs):
    moment = F.to_timestamp(F.lit("2026-01-02 03:04:05.123456"))
    left = suffix_dedup.cut_repeats(docs.withColumns({"n_chars": F.lit(7).cast("long"), "at": moment, "by": F.create_map(F.lit(3), F.lit("x")), "kept_": F.lit(1)}))
    assert left.columns == [*docs.columns, "n_chars", "at", "by", "kept_"]
    assert left.filter("by[3] = 'x' AND kept = 'clash' AND carried = 'clash'").filter(F.col("at") == moment).count() == docs.count()
    rows = {r.doc_id: r for r in left.collect()}
    assert len(rows) == docs.count() and rows[0].text == "" and rows[0].shard == "clash" and all(len(r.text) == r.n_chars for r in rows.values())


def test_difference_cover():
    for q in (2, 3, 5, 7, 11):
        d, v = suffix_dedup.difference_cover(q), q * q + q + 1
        assert len(d) == q + 1 and {(int(a) - int(b)) % v for a in d for b in d} == set(range(v))
    values = np.unique(np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64))
    assert (suffix_dedup.unpack_sorted(suffix_dedup.pack_sorted(values)) == values).all()


def test_packing(docs, nothing):
    rows = packing.pack(docs, length=64).collect()
    text, encode = dict(corpus()), encoder().ids
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for i, t in text.items():
        ids = encode(t or "") + struct.pack("<I", 2)
        at = 0
        for k, p in enumerate(sorted(pieces[i], key=lambda p: p.piece)):
            assert (p.piece, p.start, p.ids_crc32) == (k, at, zlib.crc32(ids[4 * at : 4 * (at + p.length)])) and (k == 0 or p.length == 64)
            at += p.length
        assert 4 * at == len(ids)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    least = -(-sum(n for s in sequences.values() for _, n in s) // 64)
    assert len(sequences) <= least * 1.1 + 1 and packing.pack(nothing).count() == 0


def test_best_fit():
    p = packing.BestFit(10, open_bins=2)
    assert [p.place(n) for n in (6, 7, 3, 4, 5, 6, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (3, 6)]
    p = packing.BestFit(10, open_bins=2)
    assert [p.place(n) for n in (6, 7, 8, 3)] == [(0, 0), (1, 0), (2, 0), (0, 6)]  # the bin with 7 was the fullest


def test_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["a  b", "a   b", " a", "a ", "\n a", "a \n b", "a\n\nb", "it's I'LL 'd", "x\x1c y", "a  b", "<|endoftext|> x", "", "日本語 12½", "a\tb", "a\x85b", "　x"]
    for t in [t or "" for _, t in corpus()] + odd:
        ids = encoder().ids(t)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == whole.encode(t, add_special_tokens=False).ids


def test_licenses(spark, nothing):
    mit = dict(licenses.TEMPLATES)["MIT-text"]
    rows = [(1, "Intro.\nReleased under the MIT License.\nmore text here"), (2, mit), (3, mit.replace(", ", ",\n")), (4, "Licensed under CC BY-NC 4.0"), (5, None), (6, "the the the the the"), (7, "licensed under the apache license version 2 0 now"), (1, "")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()

    def dice(text, template):
        words = lambda x: licenses.template_words(x)
        bag = lambda w: Counter(zip(w, w[1:]))
        a, b = bag(words(text)), bag(words(template))
        return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))

    for r, (_, text) in zip(sorted(got, key=lambda r: (r.doc_id, r.license is None)), sorted(rows, key=lambda r: (r[0], not r[1]))):
        units = (text or "").split("\n") + [text or ""]
        best = max(dice(u, t) for u in units for _, t in licenses.TEMPLATES)
        assert (r.license is not None) == (best >= 0.8) and (r.license is None or abs(r.dice - best) < 1e-12)
    assert {r.doc_id: r.license for r in got if r.license} == {1: "MIT", 2: "MIT-text", 3: "MIT-text", 4: "CC-BY-NC-4.0", 7: "Apache-2.0"}
    assert licenses.scan(nothing).count() == 0


def test_chat_text(spark):
    rows = [(1, 0, "user", "a & <|turn|> [x]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "assistant", None), (1, 2, "assistant", None), (None, 0, "assistant", "ü"), (2, None, None, "&lt;"), (2, 700, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chunks", F.lit(1)).withColumn("block", F.lit(2))
    got = {r.conv_id: r for r in chat.format_chats(df).select("conv_id", chat.read_turns(F.col("chunks")).alias("t"), chat.read_loss(F.col("chunks")).alias("loss"), chat.formatted(F.col("chunks")).alias("f")).collect()}
    assert [(t.role, t.text) for t in got[1].t] == [("user", "a & <|turn|> [x]"), ("assistant", "</s>[INST] ok [/INST]"), ("assistant", ""), ("assistant", "")]
    assert (got[1].loss, got[None].loss, got[2].loss) == ("</s>[INST] ok [/INST]", "ü", "z") and [t.text for t in got[2].t] == ["&lt;", "z"]
    assert got[1].f.count("<|turn|>") == 4 and "[INST]" not in got[1].f
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_parts(spark):
    part = lambda kind, **x: (kind, x.get("text"), x.get("uri"), x.get("width"), x.get("height"), x.get("seconds"), x.get("pages"))
    rows = [(1, 0, "user", [part("text", text="see <"), part("image", uri="i.png", width=57, height=28), part("audio", uri="a.mp3", seconds=2.02), part("document", uri="d.pdf", pages=2), part(None, text="!")]), (1, 1, "assistant", None)]
    r = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>"), parts_col="parts").select("attachments", "attachment_tokens", chat.formatted(F.col("chunks")).alias("f")).first()
    assert [(a.type, a.uri, a.tokens) for a in r.attachments] == [("image", "i.png", 3), ("audio", "a.mp3", 51), ("document", "d.pdf", 2048)] and r.attachment_tokens == 2102
    assert r.f == "<|turn|>user\nsee &lt;<|image:0.1|><|audio:0.2|><|document:0.3|>!<|end|>\n<|turn|>assistant\n<|end|>\n"


def test_chat_equal_turns(spark):
    """Placeholders of rows with one turn differ, and stand for their own attachments."""
    rows = [(1, 3, "user", [("image", None, f"{k}.png", 28, 28, None, None)]) for k in range(3)] + [(None, None, "user", [("audio", None, "a.mp3", None, None, 1.0, None)])] * 2
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>"), parts_col="parts").select("conv_id", "attachments", chat.formatted(F.col("chunks")).alias("f")).collect()}
    assert [f"<|image:3{x}.0|>" in got[1].f for x in ("", "~2", "~3")] == [True] * 3 and [a.uri for a in got[1].attachments] == ["0.png", "1.png", "2.png"]
    assert got[None].f.count("<|audio:") == 2 and "<|audio:-1~2.0|>" in got[None].f


def labelled(spark, n=300):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        good = rng.random() < 0.6
        text = words_of(rng, 80, 3000) if good else " ".join(f"w{rng.randrange(3000)}###" for _ in range(60))
        rows.append((i, text, int(good)))
    return spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int"), {i: y for i, _, y in rows}


def slow_statistics(text):
    words = utf8(text).split()
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    inside = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    lines = [x for x in utf8(text).split(b"\n") if x.split()]
    return len(words), sum(len(w.decode()) for w in words), sum(w.decode().count(c) for w in words for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_quality_rules(spark, docs, nothing):
    for t in ["a b\na b\n\n  \na b", "#1 * a&b", "x " * 40, "ab " * 8 + "c " + "ab " * 8, *(t for _, t in corpus())]:
        assert quality_rules.statistics(utf8(t))[0] == slow_statistics(t)
    df, labels, truth = labelled(spark)
    model = quality_rules.fit_table(df, labels)
    rows = quality_rules.apply_rules(df, model).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 30 and sum(r.kept == bool(truth[r.doc_id]) for r in held) / len(held) > 0.95
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs, model).collect()}
    for i, t in corpus():
        n = slow_statistics(t)
        assert tuple(got[i][c] for c in quality_rules.COUNTS) == n and got[i].base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (got[i].base_failed and got[i].kept)
    assert quality_rules.apply_rules(nothing, model).count() == 0
    none = quality_rules.fit_table(df, labels.limit(0))
    assert all(r.kept != r.base_failed for r in quality_rules.apply_rules(docs, none).collect())


def test_monotone_trees():
    rng = np.random.default_rng(2)
    x = rng.random((600, len(quality_rules.FEATURES)))
    y = (rng.random(600) < 0.5 + 0.4 * np.sin(9 * x[:, 2]) * (x[:, 0] > 0.4)).astype(float)
    model = quality_rules.fit(x, y, trees=30)
    for f, sign in quality_rules.MONOTONE.items():
        k = quality_rules.FEATURES.index(f)
        grid = np.repeat(rng.random((40, x.shape[1])), 25, 0)
        grid[:, k] = np.tile(np.linspace(0, 1, 25), 40)
        steps = np.diff(model.score(grid).reshape(40, 25), axis=1)
        assert (sign * steps >= -1e-12).all()

    def walk(row):
        total = model.base
        for at in model.roots:
            while model.feature[at] >= 0:
                at = model.left[at] if row[model.feature[at]] <= model.threshold[at] else model.right[at]
            total += model.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in x[:50]], model.score(x[:50]))


def test_compression_classifier(spark, docs, nothing):
    df, labels, truth = labelled(spark)
    model = quality_classifier.fit_table(df, labels)
    rows = quality_classifier.score_table(df, model).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good, bad = ([r.quality_score for r in held if truth[r.doc_id] == y] for y in (1, 0))
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.97
    scores = {r.doc_id: r.quality_score for r in quality_classifier.score_table(docs, model).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[0] == scores[40] == scores[41] and len(scores) == len(corpus())
    kept = quality_classifier.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.quality_score for r in kept.collect()} == {"clash"} and kept.count() == sum(s >= 0.3 for s in scores.values())
    assert quality_classifier.score_table(nothing, model).count() == 0
    plain = quality_classifier.fit_table(df, labels.limit(0))
    assert {r.quality_score for r in quality_classifier.score_table(docs, plain).collect()} == {0.5}


def test_exponent():
    t = np.array([1000.0, 100.0, 100.0])
    a = mixing.find_exponent(t, repetition_limit=1.5)
    w = mixing.temperature_weights(t, a)
    assert abs((w * mixing.cover_budget(t, w) / t).max() - 1.5) < 1e-6 and abs(w.sum() - 1) < 1e-12
    a = mixing.find_exponent(t, target_entropy=1.0)
    w = mixing.temperature_weights(t, a)
    assert abs(-(w * np.log(w)).sum() - 1.0) < 1e-6
    assert mixing.find_exponent(t, repetition_limit=50) == 0.0 and mixing.find_exponent(np.zeros(2)) == 0.0


def test_mixing(spark, docs, nothing):
    encode = encoder().ids
    rows = count_tokens(docs.drop("rid").withColumnRenamed("doc_id", "rid"), ["rid", "source"], "text", "tokens").collect()
    df = spark.createDataFrame(rows, "rid long, source string, tokens long")
    got = mixing.draw(df).collect()
    tokens, size = Counter(), {r.rid: r.tokens for r in rows}
    for r in rows:
        assert r.tokens == len(encode(dict(corpus())[r.rid] or "")) // 4
        tokens[r.source] += r.tokens
    names = sorted(tokens, key=lambda s: (s is not None, s or ""))
    plan = {b[0]: b for b in mixing.budgets(names, [tokens[s] for s in names])}
    drawn, taken = Counter(), defaultdict(list)
    for r in got:
        drawn[r.source] += size[r.rid]
        taken[r.source, r.epoch].append((r.position, r.rid))
    largest = max(size.values())
    for s in names:
        _, total, _, budget, full, rest = plan[s]
        assert budget >= total and budget - largest <= drawn[s] <= budget
        for e in range(full):  # a full epoch is a permutation
            assert sorted(i for _, i in taken[s, e]) == sorted(r.rid for r in rows if r.source == s)
        cut = sum(size[i] for _, i in taken[s, full])
        assert cut <= rest
    assert max(b[3] / b[1] for b in plan.values() if b[1]) <= 1.51 and sorted(map(tuple, mixing.draw(df).collect())) == sorted(map(tuple, got))
    again = mixing.mix(docs)
    assert again.columns == docs.columns and again.filter("__rid = 'clash' AND tokens = 'clash'").count() == again.count() and {r.doc_id for r in again.collect()} == {i for i, _ in corpus()}
    assert mixing.draw(df.limit(0)).count() == 0


def slow_components(rows, n, percent):
    sets = {}
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    for i, t in rows:
        w = utf8(t).translate(lower).split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, docs, nothing, words, percent):
    rng, rows = random.Random(8), corpus()
    for k in range(60):  # chains of near copies around the threshold
        w = words_of(random.Random(k % 4), 90).split()
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9)}"
        rows.append((1000 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df, words, percent).collect()}
    expected = slow_components(rows, words, percent)
    assert got == expected and len({c for _, c in got.values()}) < len(got) - 20


def test_ngram_rows(docs, nothing):
    one = ngram_join.keep_one(docs)
    assert one.columns == docs.columns and {(r["row"], r["__row"]) for r in one.collect()} == {("clash", "clash")}
    expected = slow_components(corpus(), 5, 80)
    assert one.count() == len({c for _, c in expected.values()}) and len({expected[r.doc_id][1] for r in one.collect()}) == one.count()
    assert ngram_join.join(nothing).count() == 0


def test_divide_skip():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.choice(np.arange(1, 200, dtype=np.uint64), 60)) for _ in range(80)]
    index = ngram_join.DivideSkip(sets)
    for q in (0, 10, 79):
        for least in (1, 10, 20, 40):
            found, total = index.search(sets[q], least, 80)
            every = [len(np.intersect1d(sets[q], s)) for s in sets]
            assert dict(zip(found.tolist(), total.tolist())) == {k: n for k, n in enumerate(every) if n >= least}
    for query in (np.arange(0, 260, 2, dtype=np.uint64), np.array([0, 250, 300], np.uint64)):  # not in the index, with other tokens
        found, total = index.search(query, 3, 80)
        assert dict(zip(found.tolist(), total.tolist())) == {k: n for k, n in enumerate(len(np.intersect1d(query, s)) for s in sets) if n >= 3}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    df, labels, _ = labelled(spark, 120)
    extra = spark.createDataFrame(corpus(), "doc_id long, text string").withColumn("doc_id", F.col("doc_id") + 1000)
    whole = df.unionByName(extra).withColumn("lang", F.lit("en")).withColumn("source", F.when(F.col("doc_id") < 80, "a").otherwise("b")).withColumn("n_chars", F.length("text").cast("long"))
    whole.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    once = [r.doc_id for r in spark.read.parquet(str(tmp_path / "1")).collect()]
    assert len(set(once)) == len(once) and (1040 not in once or 1000 not in once)
    assert {r.doc_id for r in docs.collect()} == set(once)


def test_pipeline_chained(spark, tmp_path):
    """Stages without a write between them, on columns of any name and type."""
    import corpus_pipeline

    df, labels, _ = labelled(spark, 120)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = df.withColumns({"lang": F.lit("en"), "source": F.lit("a"), "n_chars": F.length("text").cast("long"), "__row": F.lit(1.5), "times": F.lit("t"), "quality_score": F.lit(b"q"), "carried": F.to_timestamp(F.lit("2026-01-02 03:04:05.123456")), "by": F.create_map(F.lit(1), F.array(F.lit("x")))})
    long = spark.createDataFrame([(5000, "long " + " ".join(f"w{k * k % 3001}" for k in range(400_000)))], "doc_id long, text string")
    docs = docs.unionByName(long, allowMissingColumns=True)
    columns, first = docs.columns, docs.filter("doc_id = 1").first()
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
    kept = docs.collect()
    assert len({r.doc_id for r in kept}) > 40
    for r in kept:
        if r.doc_id < 5000:
            assert [r[c] for c in ("__row", "times", "quality_score", "carried", "by")] == [first[c] for c in ("__row", "times", "quality_score", "carried", "by")]
    assert corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).count() >= len(kept)
