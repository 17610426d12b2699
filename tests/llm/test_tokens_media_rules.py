import base64
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import words
from pyspark.sql import functions as F

from leaselens.llm import language_id, quality_rules, token_counts, webp
from leaselens.llm.common import strings


@pytest.fixture(scope="module")
def encoder():
    with open(token_counts.VOCABULARY, "rb") as f:
        return token_counts.encoding(f.read())


def test_counts_match_whole_texts(edges, edge_rows, encoder):
    want = sorted(((i, None if t is None else len(encoder.encode_ordinary(t))) for i, t in (e[:2] for e in edge_rows)), key=str)
    got = sorted((tuple(r) for r in token_counts.count_tokens(edges).collect()), key=str)
    assert got == want


def test_counts_of_nothing(none):
    assert token_counts.count_tokens(none).count() == 0


def test_cuts_are_safe(encoder):
    rng = np.random.default_rng(0)
    alphabet = list("ab1,.'sS  \n\n\t\r") + ["é", "　", "\x1c", "\x85", "don't", "…", "\U0001f600", "한", "국", "中", "'re", "'", "\u2003", "٣"]
    apart = token_counts._apart[id(encoder)]
    for _ in range(300):
        text = "".join(rng.choice(alphabet, 300))
        parts = [p for p, _ in token_counts.pieces(text, 20, apart)]
        assert "".join(parts) == text and len(parts) > 3
        assert sum(len(encoder.encode_ordinary(p)) for p in parts) == len(encoder.encode_ordinary(text))
    texts = [words(i, i) for i in range(60)] + [None, ""]
    assert token_counts.lengths(encoder, texts, 100, 30).tolist() == [len(encoder.encode_ordinary(t or "")) for t in texts]


def test_long_texts_are_split_whatever_parts_their_words(encoder):
    """Lines ended by CRLF, tabs, and no white space at all: no piece is much larger than asked for, and no count changes."""
    apart = token_counts._apart[id(encoder)]
    letters = np.random.default_rng(1).choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"), 60_000)
    for text in ("word\r\n" * 15_000, "word\tother" * 9000, "임대차계약서보증금" * 4000, "".join(letters), "合同文本测试数据" * 4000):
        sizes = [n for _, n in token_counts.pieces(text, 4096, apart)]
        assert len(sizes) >= len(text.encode()) // 4600 and max(sizes) < 4600
        assert token_counts.lengths(encoder, [text], 1 << 20, 4096).tolist() == [len(encoder.encode_ordinary(text))]


def test_another_library_counts_alike(docs_of):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    rows = [(i, words(i, 40) + " L'été, 12.5% — naïve\n\n x") for i in range(20)]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs_of(rows)).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False)) for i, x in rows}


IMAGES = [(1, 1), (7, 5), (33, 17), (2, 40)]


@pytest.mark.parametrize("size", IMAGES)
@pytest.mark.parametrize("kind", ["noise", "runs", "ramp", "two"])
def test_webp_round_trip(size, kind):
    w, h = size
    r = np.random.default_rng(w * h)
    n = w * h
    x = {
        "noise": lambda: r.integers(0, 2**32, n, dtype=np.uint32), "runs": lambda: np.repeat(r.integers(0, 2**32, n, dtype=np.uint32), 9)[:n],
        "ramp": lambda: (np.arange(n) * 65793 & 0xFFFFFFFF).astype(np.uint32), "two": lambda: r.choice(r.integers(0, 2**32, 2, dtype=np.uint32), n),
    }[kind]()
    o = webp.Options
    ways = [o(), *webp.WAYS, o(predictor=3, size_bits=4, references=True, cache_bits=10, block=3), *(o(predictor=k, size_bits=3) for k in range(14)), o(palette=True), o(palette=True, references=True, cache_bits=3)]
    for way in ways:
        if way.palette and len(np.unique(x)) > 256:
            continue
        assert (got := webp.decode(webp.encode(x, w, h, way)))[:2] == (w, h) and (got[2] == x).all(), way


def test_webp_of_another_encoder():
    """A one-pixel file that web pages use to find out whether a browser knows the format."""
    w, h, x = webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert (w, h, len(x)) == (1, 1, 1)


def test_webp_picture_of_another_encoder():
    """The alpha plane, kept in green, of the small logo in CPython's own test data, as the format's first encoder wrote it."""
    data = "UklGRtQAAABXRUJQVlA4TMcAAAAvD8ADECeiqJEk5XrnGF/n3yqZiJj/dHGN4CYw4uGLdzLIwRFcgysw6LB4FY54UTXBCAwCT5KgarBVGRzWtm1GL07Gdjy27Xf7rymuIaL/SdH9j5D3ukRJJBs6JZE08xRtDsfT5RYg9AsUvpDhg7caMp42gn8dKX5Odgj7iJ6zke+Zc0boMoLb+MxIsvdFMH0g/TYXjCEyVi2l1msjvF3jpVkV1ZyBpNlulnWKGDEPiqosUDT6MILfumtQUim1Lc/pVBQKAQAAAA=="
    w, h, x = webp.decode(base64.b64decode(data))
    plane = (x >> 8 & 255).reshape(h, w)
    assert (w, h) == (16, 16) and set((x & 0xFFFF00FF).tolist()) == {0xFF000000}
    assert plane[0].tolist() == [0, 0, 0, 0, 175, 237, 255, 255, 255, 247, 146, 11, 3, 0, 0, 0]
    assert plane[8].tolist() == [247, 255, 255, 170, 78, 166, 247, 255, 255, 255, 255, 255, 255, 255, 247, 71]
    assert plane[15].tolist() == [0, 0, 0, 0, 8, 29, 53, 66, 71, 69, 56, 31, 8, 0, 0, 0]


def test_predictions():
    left, top, right, corner = ((10, 20, 30, 40), (50, 60, 70, 80), (7, 9, 200, 255), (0, 100, 35, 90))
    p = [tuple(webp.predicted(m, *(np.array([v]) for v in (left, top, right, corner)))[0].tolist()) for m in range(15)]
    assert p[0] == p[14] == (255, 0, 0, 0) and p[1:5] == [left, top, right, corner]
    # by hand: averages round down, one after the other
    assert p[5] == (29, 37, 92, 113) and p[6] == (5, 60, 32, 65) and p[7] == (30, 40, 50, 60)
    assert p[8] == (25, 80, 52, 85) and p[9] == (28, 34, 135, 167) and p[10] == (16, 47, 83, 116)
    assert p[11] == left and p[12] == (60, 0, 65, 30) and p[13] == (45, 10, 57, 45)


def test_waves_undo_what_single_pixels_do(monkeypatch):
    r = np.random.default_rng(4)
    x, modes = r.integers(0, 2**32, 90 * 61, dtype=np.uint32), r.integers(0, 16, 23 * 16).astype(np.uint32) << 8
    waves = webp.predictor(x, 90, 61, 2, modes, True)
    assert (webp.predictor(waves, 90, 61, 2, modes, False) == x).all()
    monkeypatch.setattr(webp, "FEW_PIXELS", 1 << 20)
    assert (webp.predictor(x, 90, 61, 2, modes, True) == waves).all()


def test_stretches_meet(monkeypatch):
    """Data that is parsed in many short stretches."""
    monkeypatch.setattr(webp, "STRETCH", 256)
    x = np.random.default_rng(2).choice(np.array([1, 2, 3, 0xFF00FF00, 77], np.uint32), 400)
    for way in (*webp.WAYS, webp.Options(), webp.Options(references=True, block=2)):
        assert (webp.decode(webp.encode(x, 20, 20, way))[2] == x).all(), way


def test_large_images_come_alone_and_too_large_ones_not(spark, monkeypatch):
    """A few bytes that declare 16,384 x 16,384 pixels of one colour are an error, not a gigabyte; batches follow pixels."""
    w = webp.Writer()
    w.put(16383, 14), w.put(16383, 14), w.put(1, 1), w.put(0, 3), w.put(0, 1)
    webp._write_pixels(w, [5], 1, True)
    body = b"\x2f" + w.bytes()
    bomb = b"RIFF" + (12 + len(body) + len(body) % 2).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)
    image = webp.encode(np.full(64 * 64, 7, np.uint32), 64, 64)
    rows = spark.createDataFrame([(1, bomb), (2, image), (3, image), (4, image)], "id bigint, image binary").coalesce(1)
    got = {r.id: r for r in webp.decode_column(rows, "id", "image").collect()}
    assert "more than" in got[1].error and got[1].pixels is None and all(got[i].pixels == [7] * 4096 for i in (2, 3, 4))
    assert "more than" in webp.decode_column(rows, "id", "image", 4000).where("id = 2").first().error


def test_media_edges(spark):
    rows = [(1, [1.5] * 64), (1, [1.5] * 64), (2, None), (3, []), (None, [0.0, 2.0, None]), (5, [float(i) for i in range(10)])]
    media = webp.vector_media(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("pixels", F.lit("clash")))
    bad = media.union(spark.createDataFrame([(10, b""), (11, b"RIFF....WEBPVP8 "), (12, webp.encode(np.arange(300), 20, 15)[:60])], "vec_id bigint, image binary"))
    got = webp.decode_column(bad, "vec_id", "image").collect()
    assert len(got) == 9
    for r in got:
        if r.vec_id in (2, 3):
            assert r.pixels is None and r.error is None
        elif r.vec_id in (10, 11, 12):
            assert r.pixels is None and r.error
        else:
            want = next(v for i, v in rows if i == r.vec_id)
            assert np.array(r.pixels, np.int32).view(np.float32)[: len(want)].tolist() == [f or 0.0 for f in want] and r.width * r.height == len(r.pixels)
    assert webp.decode_column(media.limit(0), "vec_id", "image").count() == 0


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("doc_id", F.lit("clash")).withColumn("host", F.lit(1))


ENGLISH = "the of and that this with thing shed the other when there "
FRENCH = "été des les où être déjà très même après voilà français "


def test_language_of_text_and_page(spark, docs_of, none):
    rows = [(i, (ENGLISH if i % 3 else FRENCH) * 3 + words(i, 2), "en" if i % 3 else "fr") for i in range(60)]
    rows += [(100, "", None), (101, None, None), (102, "a", None), (103, "", None), (None, ENGLISH, "en"), (1, ENGLISH, "en"), (104, "des the", None)]
    pages = pages_of(spark, [(i, f"https://www.{'en' if i % 3 else 'fr'}.site.{'com' if i % 3 else 'fr'}/x/{i}{'.html' if i % 2 else '/?a=1#b'}", f"<!doctype html>\n<HTML class=x lang='{'en-GB' if i % 3 else 'FR'}'>") for i in range(60)]
             + [(200, "http://www.fr.site.fr/a/100", "<html lang=fr>"), (201, "http://new.place.fr/101", None), (202, None, None), (203, "nonsense/7", "<html>"), (5, "https://en.site.com/9", "<html lang=de>")])
    docs = docs_of([(i, t, lang, "s") for i, t, lang in rows])
    got = language_id.identify(docs, pages).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, *_ in rows if i is not None)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang == ("en" if i % 3 else "fr") == by[i].text_lang for i in range(2, 60))
    assert by[100].lang == "fr" and by[100].text_lang is None and by[100].p > 0.9 and by[100].declared == "fr"
    assert by[101].lang == "fr" and by[101].suffix == "fr" and by[101].declared is None
    assert by[103].lang == "en" and abs(by[103].p - 41 / 60) < 0.06 and by[103].host is None
    assert language_id.identify(none, pages).count() == 0
    unknown = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")), pages.limit(0)).collect()
    assert len(unknown) == len(got) and all(r.lang is None and r.p is None for r in unknown)


def test_language_posterior_matches_brute_force(spark, docs_of):
    rows = [(i, (ENGLISH if i % 4 else FRENCH)[: 3 + i % 9], "en" if i % 4 else "fr") for i in range(80)]
    pages = [(i, f"http://h{i % 3}.s{i % 2}.{'com' if i % 5 else 'fr'}/{i}", f"<html lang={'en' if i % 6 else 'fr'}>") for i in range(0, 80, 2)]
    pages += [(100 + i, f"http://h{i % 2}.other.org/{i}", "<html lang=fr>") for i in range(0, 80, 6)] + [(300, "http://h0.other.org/0", "<html>")]
    docs = docs_of([(*r, "s") for r in rows])
    names, logs = language_id.fit(docs)
    assert names == ["en", "fr"]
    count = np.full((2, 65536), language_id.SMOOTH)
    for _, t, lang in rows:
        b = t.lower().encode()
        for p, q in zip(b, b[1:]):
            count[names.index(lang), p * 256 + q] += 1
    assert np.allclose(logs, np.log(count / count.sum(1, keepdims=True)), atol=1e-5)
    ll = {}
    for i, t, _ in rows:
        b = t.lower().encode()
        ll[i] = np.array([sum(float(logs[k, p * 256 + q]) for p, q in zip(b, b[1:])) for k in range(2)]) * (len(b) - 1) ** -0.5
    best = {i: int(v[1] > v[0]) for i, v in ll.items()}
    ev: dict = {}
    for _, u, h in pages:
        mine, host = ev.setdefault(int(u.split("/")[-1]), (set(), set(), {})), u.split("/")[2]
        mine[0].update(re.findall(r"lang=(\w+)", h)), mine[1].add(host.split(".")[-1])
        mine[2][host] = ".".join(host.split(".")[1:])
    all_best = np.array([sum(b == k for b in best.values()) for k in range(2)], float)
    held = lambda e, place, v: v in (e[2].values() if place == 3 else e[place])
    tally = lambda place, value: np.array([sum(best[i] == k and held(e, place, value) for i, e in ev.items()) for k in range(2)], float)
    smooth = lambda n, parent: (n + 20 * parent) / (n.sum() + 20)
    given = {p: {v: tally(p, v) for v in set().union(*(e[p] for e in ev.values()))} for p in (0, 1)}
    for r in language_id.identify(docs, pages_of(spark, pages)).collect():
        score, own = ll[r.doc_id].copy(), np.eye(2)[best[r.doc_id]]  # a document's own guess is no evidence for it
        prior = (all_best - own + 1) / (all_best - own + 1).sum()
        if r.doc_id in ev:
            mine = ev[r.doc_id]
            score += np.mean([np.log(smooth(tally(2, h) - own, smooth(tally(3, s) - own, prior))) for h, s in mine[2].items()], 0)
            for p in (0, 1):
                for v in mine[p]:
                    score += np.log((given[p][v] - own + 1) / (sum(given[p].values()) - own + len(given[p]) + 1))
            assert (r.declared, r.suffix, r.host) == tuple(",".join(sorted(x)) for x in mine)
        else:
            score += np.log(prior)
        p = np.exp(score - score.max())
        assert r.lang == names[int(score.argmax())] and abs(r.p - (p / p.sum()).max()) < 2e-6


def test_page_evidence_has_no_cuts(spark):
    """A tag of 1,000 characters before lang, and ids up to the greatest bigint; greater ones are no document's."""
    big = 9_223_372_036_854_775_807
    pages = pages_of(spark, [(1, f"http://a.org/{big}", f'<html class="{"x" * 1000}" lang="de">'), (2, f"http://b.org/{big}", "<html data-lang=fr>"), (3, "http://c.org/99999999999999999999", "<html lang=en>")])
    got = {tuple(r) for r in language_id.page_evidence(pages).collect()}
    assert got == {(big, "de", "org", "a.org", "a.org"), (big, None, "org", "b.org", "b.org")}
    assert {tuple(r) for r in quality_rules.page_domains(pages).collect()} == {(big, "a.org"), (big, "b.org")}


def test_many_languages_are_counted_in_parts(spark, docs_of, monkeypatch):
    monkeypatch.setattr(language_id, "HELD", 2)
    rows = [(i, words(i, 9), f"l{i % 7}", "s") for i in range(70)]
    names, logs = language_id.fit(docs_of(rows))
    monkeypatch.setattr(language_id, "HELD", 64)
    assert names == [f"l{i}" for i in range(7)] and np.array_equal(logs, language_id.fit(docs_of(rows))[1])


def test_held_out_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1").toArrow()
    best = language_id.log_likelihoods(strings(held["text"]), model[1]).argmax(1)
    assert np.mean([model[0][b] == t for b, t in zip(best, held["lang"].to_pylist())]) > 0.98


def test_host_verdicts_match_brute_force(spark, docs_of):
    bad = words(1, 40).upper() + "!" * 30
    rows = [(i, bad if i % 5 == 0 and i % 2 or i < 6 else words(i, 30), "en", f"s{i % 3}") for i in range(90)]
    pages = [(i, f"https://www.h{i % 5}.org:80/a/{i}#z", "") for i in range(60)] + [(99, "https://zzz.org/300", ""), (98, "https://a.org/99999", "")]
    got = {r.doc_id: r for r in quality_rules.judge(docs_of(rows), pages_of(spark, pages)).collect()}
    host = {i: f"h{i % 5}.org" if i < 60 else f"source:s{i % 3}" for i in range(90)}
    fails = {i: {"exclaims", "shouting"} if t == bad else set() for i, t, *_ in rows}
    best: dict = {}
    for rule in (*quality_rules.RULES, None):
        n = {h: [rule in fails[i] if rule else bool(fails[i]) for i in host if host[i] == h] for h in set(host.values())}
        rate = np.array([np.mean(v) for v in n.values()])
        m, inverse = rate.mean(), np.mean([1 / len(v) for v in n.values()])
        excess = rate.var() - m * (1 - m) * inverse
        k = min(max(m * (1 - m) / excess - 1, 1), 10_000) if excess > 1e-12 else 10_000
        for h, v in n.items():
            best[h] = max(best.get(h, 0), (sum(v) + k * m) / (len(v) + k))
    for i, r in got.items():
        assert r.domain == host[i] and r.failures == len(fails[i]) and abs(r.host_rate - best[host[i]]) < 1e-5
        assert r.host_rejected == (best[host[i]] > quality_rules.HOST_LIMIT) and r.keep == (not fails[i] and not r.host_rejected)


def test_rules_and_edges(spark, docs_of, edges, none):
    pages = pages_of(spark, [(1, None, None), (2, "http://a.b/4", None), (3, "http://www.a.b/4?x", "h")])
    assert quality_rules.judge(none, pages).count() == 0
    rows = quality_rules.judge(edges, pages).collect()
    assert [r.doc_id for r in rows].count(1) == 2 and len(rows) == 13
    by = {r.doc_id: r for r in rows}
    assert by[3].failures == by[4].failures == by[5].failures == 1 and by[8].failures == 0
    assert by[4].domain == "a.b" and by[12].domain == "source:" and by[1].domain == "source:s"
    junk = [(1, "ab### " * 9), (2, "a | " * 9), (3, "no! " * 9), (4, "SHOUT AT ALL OF THEM NOW"), (5, "go stop " * 40), (6, "one two"), (7, "a 12 b 345 c 99 d")]
    fine = [(8, "임대차계약서의보증금은" * 20 + "!"), (9, words(1, 60) + "!"), (10, "合同文本。" * 40)]  # scripts without spaces aren't short of words
    got = {r.doc_id: r.failures for r in quality_rules.judge(docs_of(junk + fine), pages).collect()}
    assert got == {i: int(i < 8) for i in range(1, 11)}


def test_every_host_of_a_document_counts(spark, docs_of):
    """z.org mirrors the junk of a.org and is charged with it; what is on both gets the worse verdict."""
    junk = words(1, 40).upper() + "!" * 30
    rows = [(i, junk if i < 40 else words(i, 30)) for i in range(100)] + [(99, words(99, 30))]
    pages = [(i, f"https://{h}.org/{i}", "") for i in range(100) for h in (["a", "www.z", "z"] if i < 40 else ["b", "z"] if i == 99 else [f"c{i % 9}"])]
    got = quality_rules.judge(docs_of(rows), pages_of(spark, pages)).collect()
    assert len(got) == 101
    both = [r for r in got if r.doc_id == 99]
    assert len(both) == 2 and all(r.failures == 0 and r.domain == "z.org" and r.host_rejected and not r.keep for r in both)


def test_many_hosts_give_the_same_verdicts(spark, docs_of, monkeypatch):
    """Beyond what is broadcast, hot domains are, and the rest are joined by a shuffle."""
    rows = [(i, words(i, 30) if i % 3 else words(i, 9).upper()) for i in range(200)]
    pages = pages_of(spark, [(i, f"https://h{i % 40}.org/{i}", "") for i in range(150)])
    want = sorted(map(str, quality_rules.judge(docs_of(rows), pages).collect()))
    monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(quality_rules, "HOT_SHARE", 0.1)
    assert sorted(map(str, quality_rules.judge(docs_of(rows), pages).collect())) == want
