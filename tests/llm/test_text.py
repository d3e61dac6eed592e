"""Look-alikes, personal information, BPE, packing and reading levels."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import bpe, lookalikes, packing, pii, readability

SAME = [
    ("lucu banget", "ｌｕｃｕ ｂａｎｇｅｔ"),
    ("lucu banget", "luсu bаngеt"),
    ("lucu banget", "lu​cu ban­get"),
    ("lucu banget", "𝗹𝘂𝗰𝘂 𝚋𝚊𝚗𝚐𝚎𝚝"),
    ("café", "café"),
    ("phở", "phở"),
    ("ậ", "ậ"),
    ("ậ", "ậ"),
    ("각", "각"),
    ("각", "각"),
    ("ﬁlm", "film"),
    ("a‍b", "ab"),
    ("BMA CoC WIG", "ꓐꓟꓮ ⲤⲟⲤ ᏔᏆᏳ"),
    ("ovw-1", "ᴏᴠᴡ−1"),
]
DIFFERENT = [("cafe", "café"), ("O0", "OO"), ("rn", "m"), ("Kopi", "kopi"), ("👨‍👩‍👧", "👨👩👧"), ("می‌خواهم", "میخواهم"), ("x²", "x2"), ("a  b", "a b")]


def canon(spark, values):
    from threadloom.runtime import Stage

    rows = spark.createDataFrame([(v,) for v in values], "value string")
    got = {r.value: r.canon for r in lookalikes.canonical_forms(rows, Stage(spark, "t")).collect()}
    return {v: got.get(v, v) for v in values}


def test_equal_and_different_looks(spark):
    got = canon(spark, [x for p in SAME + DIFFERENT for x in p])
    assert all(got[a] == got[b] for a, b in SAME), [(a, b) for a, b in SAME if got[a] != got[b]]
    assert all(got[a] != got[b] for a, b in DIFFERENT), [(a, b) for a, b in DIFFERENT if got[a] == got[b]]


def test_composition_is_canonical(spark):
    rng = random.Random(3)
    marks = [chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c)) and chr(c) != "͏"]
    values = ["x" + rng.choice("aeiouAnsz") + "".join(rng.choices(marks, k=rng.randint(1, 4))) + "y" for _ in range(300)]
    assert all(c == unicodedata.normalize("NFC", v) for v, c in canon(spark, values).items())


def test_pairs_against_brute_force(spark):
    rows = [(1, "lucu", None), (2, "luсu", "a.b"), (3, "ｌｕｃｕ", "ａ.b"), (4, "lucu", "a.b"), (5, "", ""), (6, None, None), (7, "lain", "x" * 50_000 + "é"), (8, "​", None)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "pos bigint, text string, username string, value string, canon int")
    got = {tuple(r) for r in lookalikes.equal_looking_pairs(df, "pos", ["text", "username"]).collect()}
    assert got == {("text", 1, 2), ("text", 1, 3), ("text", 2, 3), ("text", 2, 4), ("text", 3, 4), ("username", 2, 3), ("username", 3, 4)}
    assert lookalikes.equal_looking_pairs(df.limit(0), "pos", ["text", "username"]).count() == 0
    assert {tuple(r) for r in lookalikes.look_classes(df, ["text", "username"]).collect()} == {("text", "lucu", 3, 4), ("username", "a.b", 2, 3)}
    out = {r.pos: r.text for r in lookalikes.with_canonical(df, ["text", "username"]).collect()}
    assert out[3] == "lucu" and out[5] == "" and out[6] is None and len(out) == 8


PII = [
    ("kirim ke galuh.halim@example.org ya", "kirim ke [EMAIL] ya"),
    ("galuh_h+cs[at]example.org", "[EMAIL]"),
    ("(galuh (at) surat (dot) example)", "([EMAIL])"),
    ("galuh at example dot org aja", "[EMAIL] aja"),
    ("wa 0878-5550-5910, cepat", "wa [PHONE], cepat"),
    ("hub +62 895 5550 5532", "hub [PHONE]"),
    ("call me (031) 555-0451", "call me [PHONE]"),
    ("0 8 9 5 5 5 5 0 0 7 4 4 ok", "[PHONE] ok"),
    ("telp ０８７８-５５５０-１００７", "telp [PHONE]"),
    ("KTP saya 9942125008936259", "KTP saya [ID_NUMBER]"),
    ("NPWP 99.830.180.6-341.000", "NPWP [ID_NUMBER]"),
    ("my ssn is 957-47-4203", "my ssn is [ID_NUMBER]"),
    ("paspor X5143733 hilang", "paspor [ID_NUMBER] hilang"),
    ("Jl Melati no 43 RT 06/RW 07 dekat", "[ADDRESS] dekat"),
    ("rumah 63 Rajawali Rd.", "rumah [ADDRESS]"),
    ("nama saya Laraswati P. Jatiwangsa!", "nama saya [NAME]!"),
    ("an Kinasih Garfika ya", "an [NAME] ya"),
    ("budi et gmail dot com", "[EMAIL]"),
    ("budi\nat\ngmail.com", "[EMAIL]"),
    ("4111 1111 1111 1111 habis", "[CARD] habis"),
    ("pakai 5500-0000-0000-0004 saja", "pakai [CARD] saja"),
    ("amex 3782 822463 10005", "amex [CARD]"),
    ("IBAN GB82 WEST 1234 5698 7654 32", "IBAN [IBAN]"),
    ("ke DE89370400440532013000 ya", "ke [IBAN] ya"),
    ("call 4155552671 now", "call [PHONE] now"),
    ("rumah Jl. Sudirman 12, dekat", "rumah [ADDRESS], dekat"),
    ("Regards, Maria Lestari", "Regards, [NAME]"),
    ("Budi Santoso (budi.santoso@mail.example)", "[NAME] ([EMAIL])"),
]
PLAIN = ["resi 8899755661903019", "kode order 2026-9747-9004", "harganya Rp 37.500.000", "versi 24.4.1", "video 7005880198196696226", "ip 10.0.90.1", "tgl 19-08-2025", "jam 01.43-15.30", "@galuh.halim lucu", "kata pak RT besok", "jalan terus pantang mundur", "parkir blok B lantai 1", "https://gerai.example/p/8930455424", "hahaha @user.name", "Mbak papers. ini", "kode 4111 1111 1111 1112", "GB82 WEST 1234 5698 7654 33", "nilai 4155552671", "Jl. Sudirman 3 kali lewat", "resi 4111111111111111", "Dear Diary ini"]


@pytest.mark.parametrize("text,out", PII)
def test_pii_is_replaced(text, out):
    assert pii.redacted(text, pii.spans(text)) == out


@pytest.mark.parametrize("text", PLAIN)
def test_pii_leaves_the_rest(text):
    assert pii.spans(text) == []


# sentences written after the detectors and not used to shape them: kinds that a reader sees in each
HELD_OUT = [
    ("Halo kak, bisa kirim invoice ke rina.wulandari@perusahaan.co.id? Makasih", {"email"}),
    ("Reach me on +1 (415) 555-2671 after six, or leave word at the desk", {"phone"}),
    ("Alamat kantor: Jl. Gatot Subroto No. 45, Kel. Menteng", {"address"}),
    ("Paketnya ke 221 Baker Street ya, atas nama Sherlock Holmes", {"address", "name"}),
    ("my passport is C01234567 and it expired", {"id_number"}),
    ("Contact person: Andi Wijaya, 0812-3456-7890", {"name", "phone"}),
    ("Dr. Siti Nurhaliza membuka praktik baru", {"name"}),
    ("transfer ke rekening NL91 ABNA 0417 1643 00", {"iban"}),
    ("kartu saya 4539 5787 6362 1486 ditolak", {"card"}),
    ("Warm regards, Peter Jansen", {"name"}),
    ("Yesterday Karen Whitfield told us to wait outside", {"name"}),
    ("Tinggal di Perumahan Bumi Asri blok C-7", {"address"}),
    ("SSN 536-22-8134 was on the form", {"id_number"}),
    ("email saya: joko [at] surel [dot] id", {"email"}),
    ("Hubungi Ibu Ratna Sari di 021-555-7788", {"name", "phone"}),
    ("skor akhir 3-2, penonton 45.000 orang", set()),
    ("Order 4500012345 dikirim 12-05-2024", set()),
    ("versi 10.2.3.4 sudah rilis, cek video 7312345678901234567", set()),
    ("New York Times menulis soal Jakarta Selatan", set()),
    ("harga Rp 1.250.000 untuk 24 jam", set()),
    ("buka jam 08.00 - 17.00, tutup 31/12/2024", set()),
    ("Dear Customer Service, kapan barang saya sampai?", set()),
    ("lantai 3 gedung B, parkir 2 jam", set()),
    ("@maria.lestari makasih infonya", set()),
]


def test_held_out_sentences():
    true = found = both = 0
    for text, kinds in HELD_OUT:
        got = {k for *_, k in pii.spans(text)}
        true, found, both = true + len(kinds), found + len(got), both + len(kinds & got)
    assert both / true >= 0.85 and both / found >= 0.85, (true, found, both)


def test_findings_are_those_of_spans(spark):
    rng = random.Random(4)
    texts = [t for t, _ in PII] + PLAIN + [t for t, _ in HELD_OUT]
    texts += ["".join(rng.choice(x) for x in zip(a.ljust(40), b.ljust(40))) for a, b in zip(rng.choices(texts, k=200), rng.choices(texts, k=200))]
    texts += [a.upper() for a in texts[:80]] + [a.replace(" ", "\u00a0") for a in texts[:80]] + [a.replace(" ", "\n") for a in texts[:80]]
    rows = spark.createDataFrame(list(enumerate(texts)), "key bigint, text string")
    got = {r.key: (r.text, r.kinds) for r in pii.findings(rows, "key", "text").collect()}
    want = {}
    for i, t in enumerate(texts):
        plain, _ = pii.plain_copy(t)
        if s := pii.spans(t):
            want[i] = (pii.redacted(t, s), list(dict.fromkeys(k for *_, k in s)))
        # what a text needs for a kind or a detector, every match has
        for d in pii.DETECTORS:
            for m in d.pattern.finditer(plain):
                assert pii._NEEDS[d.kind].search(plain) and sum(c.isdigit() for c in m.group()) >= pii._DIGITS[d], (d.pattern, t)
    assert got == want


def test_validators():
    assert pii.card("4539578763621486") and not pii.card("4539578763621487") and not pii.card("9999999999999995")
    assert pii.iban("GB82 WEST 1234 5698 7654 32") and not pii.iban("GB82 WEST 1234 5698 7654 3")
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    assert pii.mod97("85073003328") and not pii.mod97("85073003329")
    assert pii.resident_id("9942125008936259") and not pii.resident_id("8899755661903019")


def test_pii_rows(spark):
    long_ = "kata " * 100_000 + "wa 0878-5550-5910"
    df = spark.createDataFrame([(1, "a@b.example", "x"), (1, "a@b.example", "x"), (2, None, "x"), (3, "", "x"), (4, long_, "x")], "key bigint, body string, text string")
    assert sorted(r.key for r in pii.findings(df, "key", "body").collect()) == [1, 1, 4]
    out = {r.key: r.body for r in pii.with_placeholders(df.where("key > 1"), "key", "body").collect()}
    assert out[2] is None and out[3] == "" and out[4].endswith("wa [PHONE]")
    assert pii.findings(df.limit(0), "key", "body").count() == 0


def test_bpe_equals_the_library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(1)
    texts = ["a\n \nb  c   d\t e", " a b ", "'s it's I'LL", "x" * 1000, "ab" * 5000 + " zz", "<|endoftext|> a", "  \n\n  a", "a \x1c b", "日本語 " * 20, "é́" * 300, "0123456789" * 50]
    texts += ["".join(rng.choices("ab \n\t'é1.😀", k=rng.randint(0, 60))) for _ in range(500)]
    own = bpe.ByteBPE()
    assert [own.encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    word = bytes(rng.choices(range(97, 105), k=400))
    assert own._scan(word) == own._heap(word)


def test_bpe_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "hello world", 0), (3, "hello world", 0)], "doc_id bigint, text string, made int")
    got = sorted((r.doc_id, r.ids) for r in bpe.token_ids(df, "doc_id", "text").collect())
    assert got == [(1, []), (2, []), (3, [31373, 995]), (3, [31373, 995])]
    assert sorted((r.doc_id, r.n_tokens) for r in bpe.token_counts(df, "doc_id", "text").collect()) == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert bpe.token_ids(df.limit(0), "doc_id", "text").count() == 0


def test_fullest_is_optimal():
    rng = random.Random(2)
    for _ in range(200):
        room = rng.randint(1, 40)
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        best = {0}
        for s, n in counts.items():
            best |= {b + s * k for b in best for k in range(1, n + 1)}
        combo = packing.fullest(room, counts)
        assert sum(s * k for s, k in combo.items()) == max(b for b in best if b <= room)
        assert all(k <= counts[s] for s, k in combo.items())


def test_pack_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_AT_ONCE", 50)  # several salts
    rng = random.Random(4)
    items = [(i, rng.choice([0, 3, 17, 17, 17, 40, 99, 100, 101, 250])) for i in range(600)] + [(600, None)]
    df = spark.createDataFrame([(*x, 0, 0) for x in items], "key bigint, n bigint, size int, part int")
    rows = packing.pack(df, "key", "n", 100).collect()
    used, sizes = {}, {}
    for r in rows:
        used[r.container_id] = used.get(r.container_id, 0) + r.n
        sizes.setdefault(r.key, []).append(r.n)
    assert max(used.values()) <= 100 and {k: sum(v) for k, v in sizes.items()} == {k: n or 0 for k, n in items}
    assert all(len(sizes[k]) == max(1, -(-(n or 0) // 100)) for k, n in items)
    assert len(used) <= -(-sum(used.values()) // 100) * 1.05 + 1
    assert packing.pack(df.limit(0), "key", "n", 100).count() == 0


def test_isotonic_is_monotone_and_means():
    rng = np.random.default_rng(0)
    s = rng.normal(size=300)
    t = (s + rng.normal(size=300) > 0).astype(float)
    first, last, value = readability.isotonic(s, t)
    assert (np.diff(value) > 0).all() and (last[:-1] < first[1:]).all()
    assert abs(sum(v * ((s >= a) & (s <= b)).sum() for a, b, v in zip(first, last, value)) - t.sum()) < 1e-9


def test_reading_levels_on_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").where("source is null or source <> 'raw_dump'").where(F.regexp_count("text", F.lit(r"\S+")) >= 40)
    grades = spark.read.parquet(f"{d}/reading_labels.parquet")
    fit, held = grades.where("doc_id % 4 <> 0"), grades.where("doc_id % 4 = 0")
    got = readability.reading_levels(docs.select("doc_id", "text"), fit).join(held.select("doc_id", F.col("level").alias("truth")), "doc_id").toPandas()
    assert len(got) > 300 and (got["level"] == got["truth"]).mean() > 0.92


def test_reading_levels_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "kata " * 200_000), (4, "Kami makan.")], "doc_id bigint, text string")
    none = spark.createDataFrame([(9, 1), (1, None)], "doc_id bigint, level bigint")
    assert {r.level for r in readability.reading_levels(docs, none).collect()} == {None}
    one = spark.createDataFrame([(1, 2), (1, 2)], "doc_id bigint, level bigint")
    assert {r.level for r in readability.reading_levels(docs, one).collect()} == {2}
    assert readability.reading_levels(docs.limit(0), one).count() == 0
