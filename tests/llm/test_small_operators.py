"""Language ID, secrets, quality rules, BPE, line dedup and the pipeline against brute force."""

import base64
import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nestq.llm import bpe_stream, language_id, line_dedup, quality_rules, secret_scan

EDGE = [(900, ""), (901, None), (902, " \n\t"), (903, "\n\n"), (None, "x y"), (None, "x y")]


# --- BPE ----------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def coders():
    from tokenizers import Tokenizer

    path = bpe_stream.default_vocabulary()
    return bpe_stream.Transducer(bpe_stream.read_vocabulary(path)), Tokenizer.from_file(path)


def test_bpe_equals_the_library(coders, prose):
    mine, theirs = coders
    rnd = random.Random(4)
    texts = [prose(i, 50) for i in range(20)] + ["", "a<|endoftext|>b <|endoftext|>", "  x\n\n  y 　 z", "é漢字 ñ 😀👩‍👩‍👧", "don't I'll we've", "\x00\x1c\x85"]
    texts += ["".join(chr(rnd.choice([rnd.randrange(1, 0x250), rnd.randrange(0x250, 0xD7FF), rnd.randrange(0xE000, 0x1FFFF)])) for _ in range(80)) for _ in range(50)]
    texts += ["".join(rnd.choice(a) for _ in range(4000)) for a in ("ab", "aeinrst", "thean", "=-_", "0123456789", " ")] + ["aa" * 3000]
    for t in texts:
        want = theirs.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == want
        assert mine.decode(want) == theirs.decode(want, skip_special_tokens=False)


def test_bpe_window_needs_no_more_than_the_lookahead(coders):
    mine, theirs = coders
    small = bpe_stream.Transducer(bpe_stream.read_vocabulary(bpe_stream.default_vocabulary()), window=1)
    assert small.window < 2 * small.lookahead + 100
    rnd = random.Random(5)
    t = "".join(rnd.choice("theaonirs") for _ in range(9000))
    assert small.encode(t) == theirs.encode(t, add_special_tokens=False).ids


def test_bpe_stretches_change_nothing(coders, prose, monkeypatch):
    mine, theirs = coders
    monkeypatch.setattr(bpe_stream, "STRETCH", 40)
    texts = [prose(90, 400), "a  b   c\n d\te 's 't x" * 30, "word" * 200, " " * 500 + "x y" * 100, "漢字 é 😀 " * 60 + "<|endoftext|> z" * 9, " x" * 300]
    for t in texts:
        want = theirs.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == want
        back = theirs.decode(want, skip_special_tokens=False)
        assert mine.digests(t) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_bpe_of_a_long_text_holds_little(coders, prose):
    import tracemalloc

    mine, _ = coders
    text = prose(91, 2000) * 400  # about 4 MB
    mine.digests(text[:100_000])
    tracemalloc.start()
    mine.digests(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(text) * 1.5 + (6 << 20)  # the split by special tokens copies the text once


def test_bpe_window_grows_while_no_token_is_final():
    symbols = bpe_stream.byte_symbols()
    vocab, merges = {c: i for i, c in enumerate(symbols)}, []
    grown = "c"
    for _ in range(700):
        merges.append([grown, "b"])
        grown += "b"
        vocab[grown] = len(vocab)
    mine = bpe_stream.Transducer(json.dumps({"model": {"vocab": vocab, "merges": merges}}), window=16)
    text = "c" + "b" * 1300
    assert mine.encode(text) == mine.merge(text.encode())


def test_bpe_decode_of_any_ids(coders):
    mine, theirs = coders
    rnd = random.Random(6)
    ids = [rnd.randrange(50257) for _ in range(3000)]
    assert mine.decode(ids, at_once=7) == theirs.decode(ids, skip_special_tokens=False)


def test_bpe_table(spark, coders, prose):
    rows = [(i, prose(i, 30), "clash") for i in range(10)] + [(i, t, "c") for i, t in EDGE]
    df = spark.createDataFrame(rows, "doc_id long, text string, bpe_ids string")
    got = bpe_stream.encode_decode(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.bpe_ids == coders[1].encode(r.text or "", add_special_tokens=False).ids and r.bpe_decoded == (r.text or "")
    assert bpe_stream.encode_decode(df.limit(0)).count() == 0


# --- languages ----------------------------------------------------------------------------------------
def test_language_sizes_equal_brute_force(spark, prose):
    import zstandard

    labelled = [(i, prose(i, 60), "en") for i in range(12)] + [(50 + i, " ".join(w[::-1] for w in prose(i, 60).split()), "ne") for i in range(12)]
    texts = [prose(300 + i, 1 + 40 * i) for i in range(12)] + [" ".join(w[::-1] for w in prose(400 + i, 90).split()) for i in range(6)] + ["x", "12 34", "é漢字 text", "The 1st, of 2 and!\n" * 200]
    made = language_id.fit(spark.createDataFrame(labelled, "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + EDGE, "doc_id long, text string")
    got = [(r.text, r.lang_pred, r.lang_score, r.lang_rejected) for r in language_id.identify(df, made).collect()]
    assert len(got) == len(texts) + len(EDGE)
    for text, pred, score, rejected in got:
        if not text or not any(c.isalpha() for c in text):
            assert (pred, score, rejected) == ("und", 0.0, True)
            continue
        data = re.sub(r"[\W\d_]+", " ", text.lower()).encode()
        sizes = {}
        for name, held in made.items():
            sizes[name] = 0
            for at in range(0, len(data), language_id.BLOCK):
                fresh = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
                sizes[name] += len(fresh.compress(data[at : at + language_id.BLOCK]))
        (low, best), (high, _) = sorted((n, name) for name, n in sizes.items())[:2]
        # a dictionary prepared beforehand may compress a block by a few bytes more or less
        assert abs(score - (high - low) / high) < 0.05 and (pred == best or high - low <= 6)
        assert rejected == (score < language_id.LEAST_MARGIN)


def test_too_many_labels_are_an_error(spark):
    df = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    assert len(language_id.fit(df)) == 5
    with pytest.raises(ValueError, match="distinct labels"):
        language_id.fit(df, most_languages=4)


# --- secrets ------------------------------------------------------------------------------------------
def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x80 + (len(body).bit_length() + 7) // 8]) + len(body).to_bytes((len(body).bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


KEY = der(0x30, der(2, b"\0"), *(der(2, bytes(range(1, 60))) for _ in range(8)))


def prefixed(*parts):
    return b"".join(len(x).to_bytes(4, "big") + x for x in parts)


def openssh_key(name=b"ssh-ed25519", check=b"abcd", again=b"abcd"):
    private = check + again + prefixed(name, bytes(32), bytes(64), b"me")
    private += bytes(range(1, 1 + -len(private) % 8))
    return secret_scan.OPENSSH + prefixed(b"none", b"none", b"") + (1).to_bytes(4, "big") + prefixed(prefixed(name, bytes(32)), private)


OID, BITS = der(6, b"\x2a\x86\x48\xce\x3d\x02\x01"), der(3, b"\0" + bytes(range(65)))
PKCS8 = der(0x30, der(2, b"\0"), der(0x30, OID), der(4, bytes(range(60))))
SEC1 = der(0x30, der(2, b"\1"), der(4, bytes(range(32))), der(0xA0, OID), der(0xA1, BITS))
SPKI = der(0x30, der(0x30, OID), BITS)
CERTIFICATE = der(0x30, der(0x30, *(der(2, bytes([i, 9])) for i in range(7))), der(0x30, OID), BITS)


@pytest.mark.parametrize("key", [KEY, PKCS8, SEC1, SPKI, CERTIFICATE])
def test_known_key_encodings_in_pem(key):
    for pad in range(3):  # lengths that need 0, 1 and 2 padding signs
        body = der(0x30, *([key[len(key) - len(secret_scan_body(key)) :]])) if pad == 0 else key
        for width in (64, 20):
            b64 = base64.b64encode(body).decode()
            lines = "\n".join(b64[i : i + width] for i in range(0, len(b64), width))
            text = f"x -----BEGIN KEY-----\n{lines}\n-----END KEY-----\nnext words"
            found = [s for s in secret_scan.spans(text) if s[0] == "der"]
            assert found == [("der", text.index(b64[:10]), text.index("\n-----END"))]


def secret_scan_body(key):
    """The content of an outer SEQUENCE."""
    return key[2:] if key[1] < 128 else key[2 + (key[1] & 127) :]


def test_signatures_and_other_structures_are_no_keys():
    signature = der(0x30, der(2, bytes(range(1, 33))), der(2, bytes(range(1, 33))))
    odd = [signature, der(0x30, der(0x30, OID), der(4, b"short")), der(0x30, der(2, b"\5"), der(0x30, OID), der(4, bytes(40))), der(0x30, der(2, b"\0"), der(0x30, der(4, b"x" * 30)), der(4, bytes(40)))]
    for data in odd:
        assert not secret_scan.is_der_key(data)
        assert not [s for s in secret_scan.spans("v " + base64.b64encode(data).decode() + " w") if s[0] == "der"]
    assert secret_scan.is_openssh_key(openssh_key())
    assert not secret_scan.is_openssh_key(openssh_key(again=b"abce"))
    assert not secret_scan.is_openssh_key(openssh_key(name=b"\0\0"))
    assert not secret_scan.is_openssh_key(openssh_key()[:-9])


def test_structure_confirms_secrets():
    b64 = base64.b64encode(KEY).decode()
    token = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (json.dumps({"alg": "HS256", "typ": "JWT"}).encode(), b'{"sub":"1234567890"}', b"signature!"))
    openssh = base64.b64encode(openssh_key()).decode()
    text = f"é key {b64} and {token} or {openssh} hex {KEY.hex().upper()} end"
    found = [s for s in secret_scan.spans(text) if s[0] in ("der", "openssh", "jwt")]
    assert [k for k, _, _ in found] == ["der", "jwt", "openssh", "der"]
    for _, a, b in found:
        assert text[a:b] in (b64, token, openssh, KEY.hex().upper())
    wrong = base64.b64encode(KEY[:-1] + b"\0\0").decode()
    assert not [s for s in secret_scan.spans(f"{wrong} eyJub3QiOiJoZWFkZXIifQ.eyJzdWIi.x {'QUJD' * 20}") if s[0] in ("der", "jwt", "openssh")]


@pytest.mark.parametrize("extra", [0, 1, 2])
@pytest.mark.parametrize("width", [32, 64, 10_000])
def test_wrapped_keys(extra, width):
    key = der(0x30, der(2, b"\0"), *(der(2, bytes(range(1, 60))) for _ in range(8)), der(4, b"\1" * (10 + extra)))
    for coded in (base64.b64encode(key).decode(), base64.urlsafe_b64encode(key).decode()):
        for body in (coded, coded.rstrip("=")):
            body = "\n".join(body[i : i + width] for i in range(0, len(body), width))
            for before, after in (("-----BEGIN PRIVATE KEY-----\n", "\n-----END PRIVATE KEY-----\n"), ("key: ", "\nNext line"), ("", "\nNext\n"), ("'", "' more")):
                text = before + body + after
                assert [text[a:b] for k, a, b in secret_scan.spans(text) if k == "der"] == [body]


def test_base_spans_equal_brute_force():
    rnd = random.Random(8)
    parts = ["password", "PASSWD", "ſecret", "secret", "toKen", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "zz", "\n", "é", "deadbeef", "K"]
    for _ in range(400):
        t = "".join(rnd.choice(parts) for _ in range(25))
        want = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        got = [s for s in secret_scan.spans(t) if s[0] in ("assign", "access", "hex")]
        assert sorted(got) == sorted(want)


def test_secret_table(spark):
    df = spark.createDataFrame([(1, "token: abcdefghijklmnop", "c"), *((i, t, "c") for i, t in EDGE)], "doc_id long, text string, secret_spans string")
    got = {r.doc_id: r.secret_spans for r in secret_scan.scan(df).collect()}
    assert [tuple(s) for s in got[1]] == [("assign", 0, 23)] and got[901] == []
    assert secret_scan.scan(df.limit(0)).count() == 0


# --- quality ------------------------------------------------------------------------------------------
def test_statistics_equal_brute_force(prose):
    rnd = random.Random(3)
    for i in range(60):
        t = prose(i, rnd.randrange(0, 40)) + rnd.choice(["", " # $ é x", "\nsame line here\nsame line here", " a b c d e f a b c d e f", " \x1c z"])
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {k + j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert quality_rules.statistics(t) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(lines))


def test_statistics_of_long_texts(monkeypatch, prose):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 200))) for _ in range(60)] + [prose(7, 400), "x " * 50, "a b c d e f g"]
    short = [quality_rules.statistics(t) for t in texts]
    monkeypatch.setattr(quality_rules, "LONG_WORDS", 4)
    assert [quality_rules.statistics(t) for t in texts] == short
    monkeypatch.undo()
    assert quality_rules.statistics(prose(1, 60_000) + " one two three four five" * 2)[4] >= 10


def test_quality_of_clashing_columns_and_null_ids(spark, prose):
    df = spark.createDataFrame([("k1", prose(1, 40), "a", 1, 1, "f"), (None, None, None, None, None, None), (None, None, None, None, None, None)], "doc_id string, text string, `so.urce` string, n_words long, host long, _failed_host string")
    got = quality_rules.judge(df, host="so.urce").collect()
    assert sorted((r.doc_id or "", r.n_words, r.kept, r._failed_host) for r in got if r.doc_id) == [("k1", 40, True, "f")]
    assert len(got) == 3 and not any(r.kept for r in got if r.doc_id is None)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_host_verdicts(spark, prose, limit):
    good = [(i, prose(i, 40), f"h{i % 5}") for i in range(100)]
    bad = [(200 + i, "too short", "spam") for i in range(50)] + [(300, prose(300, 40), "spam"), (301, "short", "new"), (302, prose(302, 40), None), (303, "x", None), (304, None, "h1")]
    df = spark.createDataFrame([(*r, True) for r in good + bad], "doc_id long, text string, source string, kept boolean")
    got = {r.doc_id: r for r in quality_rules.judge(df, broadcast_hosts=limit).collect()}
    assert len(got) == len(good) + len(bad)
    assert all(got[i].kept for i, _, _ in good)
    assert got[300].host_failed and not got[300].kept and not got[300].base_failed
    assert got[302].kept and not got[303].kept and not got[301].kept and not got[304].kept
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_small_hosts_are_shrunk():
    mean, strength = quality_rules.prior(100, 10_000, 500, 100 * 100 * (0.05**2 + 0.01))
    assert mean == 0.05 and 1 <= strength <= quality_rules.MOST_STRENGTH
    assert (1 + strength * mean) / (1 + strength) < 0.6  # one failing document doesn't damn its host
    assert quality_rules.prior(0, 0, 0, 0.0) == (0.0, 1.0)


# --- language -----------------------------------------------------------------------------------------
def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = language_id.fit(docs.where(language_id.fold(F.col("doc_id"), 3) != 1))
    found = language_id.identify(docs.where(language_id.fold(F.col("doc_id"), 3) == 1), made)
    r = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.avg(F.col("lang_rejected").cast("double"))).first()
    assert r[0] > 0.96 and r[1] < 0.05


def test_language_edges(spark):
    made = {"en": b"the cat and the dog " * 50, "fr": b"le chat et le chien " * 50}
    df = spark.createDataFrame([(1, "the dog and the cat", "c"), (2, "12 34!", "c"), *((i, t, "c") for i, t in EDGE)], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: r for r in language_id.identify(df, made).collect()}
    assert got[1].lang_pred == "en" and 0 < got[1].lang_score <= 1
    assert all(got[i].lang_pred == "und" and got[i].lang_score == 0 and got[i].lang_rejected for i in (2, 900, 901, 902, 903))
    assert language_id.identify(df, {}).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(df, {"en": b"abc"}).where("doc_id = 1").first().lang_score == 1
    assert language_id.fit(df.selectExpr("doc_id", "text", "cast(null as string) as lang")) == {}


# --- lines --------------------------------------------------------------------------------------------
def dropped(rows, min_docs, keep_first):
    seen = defaultdict(set)
    lead = {}
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            k = line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            if k:
                seen[k].add((i, t))
                at = (i is not None, i or 0, n)
                lead[k] = min(lead.get(k, at), at)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = []
        for n, line in enumerate(lines):
            k = line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            gone = k and len(seen[k]) >= min_docs and not (keep_first and lead[k] == (i is not None, i or 0, n))
            if not gone:
                stay.append(line)
        out[i] = ("\n".join(stay), len(lines), len(lines) - len(stay))
    return out


@pytest.mark.parametrize(("min_docs", "keep_first", "parts"), [(10, False, 8), (3, True, 8), (2, True, 31), (10, False, 31)])
def test_lines_equal_brute_force(spark, prose, min_docs, keep_first, parts):
    rnd = random.Random(min_docs)
    shared = [prose(500 + i, 4) for i in range(12)] + ["HOT line", "hot LINE ", " "]
    rows = [(i, "\n".join(rnd.choice([*shared, "hot line", "", prose(i * 100 + k, 3)]) for k in range(rnd.randrange(1, 12)))) for i in range(150)]
    rows += [(900, ""), (901, None), (902, " \n\t"), (None, "HOT line\nx y")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_lines int").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df, min_docs=min_docs, keep_first=keep_first).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == dropped(rows, min_docs, keep_first)


def test_lines_of_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a\nb")] * 20 + [(2, "a")], "doc_id long, text string")
    assert all(r.n_dropped == 0 for r in line_dedup.dedup_lines(df).collect())  # two documents, not 21
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


# --- pipeline -----------------------------------------------------------------------------------------
def test_pipeline_stages(spark, coders):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "bpe"]
    counts = [docs.count()]
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf).cache()
        counts.append(out.count())
        if name == "language_id":
            assert out.where("lang is null").count() == 0
        if name == "line_dedup":
            want = dropped([(r.doc_id, r.text) for r in docs.collect()], 10, True)
            assert {r.doc_id: r.text for r in out.collect()} == {k: v[0] for k, v in want.items()}
        if name != "bpe":
            assert out.columns == docs.columns
            docs = out
        else:
            texts = {r.doc_id: r.text for r in docs.collect()}
            for r in out.collect():
                assert r.round_trip and r.token_ids == coders[1].encode(texts[r.doc_id] or "", add_special_tokens=False).ids
    assert counts[0] >= counts[1] == counts[2] > counts[3] >= counts[4] == counts[5] > 0


def test_pipeline_keeps_one_text_of_many_copies(spark, prose):
    import corpus_pipeline as cp

    text = "\n".join(prose(700 + i, 12) for i in range(4))
    rows = [(i, text, "en", "web", len(text)) for i in range(12)] + [(100 + i, prose(800 + i, 30), "en", "web", 1) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in cp.dedup_near(spark, cp.dedup_lines(spark, docs, ""), "").collect()}
    assert [i for i, t in got.items() if t == text] == [0]
    assert all(got[100 + i] == rows[12 + i][1] for i in range(5))


def test_pipeline_stages_hand_python_small_batches(spark, prose):
    import corpus_pipeline as cp

    from nestq.llm.common import BATCH_BYTES, BATCH_ROWS

    def seen(df):
        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

        return [r.n for r in df.mapInArrow(sizes, "n long").collect()]

    names = [f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(x) for x in names]
    docs = spark.createDataFrame([(i, prose(i, 12), "en", "web", 1) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
    many, long = spark.range(0, 12_000, 1, 1), spark.range(0, 24, 1, 1).selectExpr("repeat('abcdefgh', 131072) AS text")
    try:
        for _, stage in cp.STAGES:
            for x in names:
                spark.conf.unset(x)
            stage(spark, docs, "/root/testdata/sf0.001")
            got = seen(many)
            assert sum(got) == 12_000 and max(got) <= BATCH_ROWS
            got = seen(long)
            assert sum(got) == 24 and max(got) <= (BATCH_BYTES >> 20) + 1
        spark.conf.set(names[0], "100")
        spark.conf.set(names[1], "1m")
        cp.identify_language(spark, docs, "")
        assert [spark.conf.get(x) for x in names] == ["100", "1m"]
        spark.conf.set(names[0], "0")  # no bound
        cp.identify_language(spark, docs, "")
        assert spark.conf.get(names[0]) == str(BATCH_ROWS)
    finally:
        for x, value in zip(names, before, strict=True):
            spark.conf.set(x, value)
