import json
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leaselens.functions import geometry
from leaselens.functions import text as tx
from leaselens.operators import clauses, documents, fields, jobs, layout, privacy, rules, search
from leaselens.schemas import REGION
from leaselens.sources import files, images, pixels, providers
from leaselens.streaming import jobs as stream


def test_typo_tables():
    assert len(tx.TYPOS_A) == 65 and len(tx.TYPOS_B) == 30
    more = tx.with_terms({"월세": ["월셰", "월세"], "전월세": ["월쎄"]})
    assert len(more) == 66 and dict(more)["월쎄"] == "전월세" and len(tx.TYPOS_A) == 65


def test_scores_stay_in_range_and_forms_agree(spark):
    words = ["보증금", "반환", "위약금", "50%", "전액", "확정일자", "수리", "갱신", "10%", "인상", "1년", "기간", "임의로 해지"]
    rng = np.random.default_rng(0)
    rows = [(str(i), " ".join(rng.choice(words, rng.integers(0, 9)))) for i in range(60)] + [("null", None)]
    df = spark.createDataFrame(rows, "contract_id string, text string")
    one = {r.contract_id: (r.api_score, r.worker_score) for r in rules.rule_counts(df).collect()}
    assert all(0 <= s <= 100 for v in one.values() for s in v)
    two = {r.contract_id: (r.api_score, r.worker_score) for r in rules.scores_of(rules.findings(df)).collect()}
    assert {k: v for k, v in one.items() if v != (0, 0)} == two


def test_kept_boxes_don_t_overlap(spark):
    rng = np.random.default_rng(1)
    rows = [(f"d{i % 3}", i, "e", str(i), float(rng.random()), *map(int, rng.integers(0, 60, 2)), *map(int, rng.integers(5, 30, 2))) for i in range(90)]
    df = spark.createDataFrame(rows, REGION)
    kept = layout.without_overlaps(df)
    pairs = kept.alias("a").join(kept.alias("b"), "doc_id").where("a.pos < b.pos")
    box = lambda s: F.struct(*(F.col(f"{s}.{c}").alias(c) for c in "xywh"))
    assert pairs.where(geometry.iou(box("a"), box("b")) > 0.5).count() == 0 and 0 < kept.count() < 90
    assert layout.without_overlaps(kept).count() == kept.count()
    assert layout.overlapping_pairs(kept).count() == 0
    assert layout.confident(df, 0.5).where("confidence < 0.5").count() == 0


def test_overlaps_of_equal_boxes_and_many_sizes(spark, monkeypatch):
    """Places of many equal boxes are paired once for all, and no pair is lost or told twice; negative places and broken numbers, too."""
    monkeypatch.setattr(layout, "PLACE", 7)
    monkeypatch.setattr(layout, "PAIRS", 200)
    r = random.Random(4)
    for scale in (1, 1.5):
        rows = [(r.choice(["p", "q"]), r.randint(1, 10**6), *(scale * v for v in r.choice([(3, 3, 40, 40), (-70, -5, 9, 300), (r.randint(-90, 90), r.randint(-90, 90), r.randint(0, 120), r.randint(0, 120))]))) for _ in range(400)]
        kind = "long" if scale == 1 else "double"
        want = set()
        for i, a in enumerate(rows):
            for b in rows[i + 1 :]:
                wide, high = (min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k]) for k in (2, 3))
                if a[0] == b[0] and a[1] != b[1] and wide > 0 and high > 0 and (iou := wide * high / (a[4] * a[5] + b[4] * b[5] - wide * high)) > 0.5:
                    want.add((a[0], *sorted((a[1], b[1])), round(iou, 9)))
        df = spark.createDataFrame([*rows, (None, 1, *rows[0][2:]), ("p", None, *rows[0][2:])], f"doc_id string, pos int, x {kind}, y {kind}, w {kind}, h {kind}")
        got = [(g.doc_id, g.a, g.b, round(g.iou, 9)) for g in layout.overlapping_pairs(df).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 5000
        assert dict(layout.overlapping_pairs(df).dtypes) == {"doc_id": "string", "a": "int", "b": "int", "iou": "double"}


def test_clauses_are_sorted_once(spark):
    """One sort serves both numbers; lines of one place are numbered together."""
    rows = [(1, 0, "② 앞"), (1, 1, "제1조 (가) 나"), (1, 2, "이어지는 줄"), (1, 3, "① 다"), (1, 4, "1호 라"), (1, 5, "제2조 (마) 바"), (1, 6, "2호 빠짐"), (1, 7, "3. 사"), (1, 8, None), (2, 0, "제9조 (아) 자"), (2, 0, "1. 차"), (2, 1, "2. 카")]
    got = clauses.clauses(spark.createDataFrame(rows, "doc_id long, pos long, line string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1
    assert sorted((r.doc_id, r.pos, r.level, r.article_no, r.paragraph_no, r.number) for r in got.collect()) == [
        (1, 1, 0, 1, 0, "제1조"), (1, 3, 1, 1, 1, "①항"), (1, 4, 2, 1, 1, "1호"), (1, 5, 0, 2, 0, "제2조"), (1, 7, 1, 2, 1, "3항"),
        (2, 0, 0, 1, 1, "제9조"), (2, 0, 1, 1, 1, "1항"), (2, 1, 1, 1, 2, "2항"),
    ]


def test_votes_find_their_groups_once(spark):
    """All strategies' votes are those of each alone, from one pass over the boxes."""
    r = random.Random(6)
    rows = [(d, p, r.choice(["trocr", "paddle", "easy"]), r.choice("abc"), r.randint(1, 9) / 10, r.randint(0, 4) * 3, 0, 10, 10) for d in range(12) for p in range(7)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, engine string, text string, confidence double, x int, y int, w int, h int")
    names = ("majority", "confidence_weighted", "trocr_priority")
    got = layout.votes(df, names)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 1
    one = {(n, *v) for n in names for v in layout.vote(df, n).collect()}
    assert {(v[-1], *v[:-1]) for v in got.collect()} == one and len(one) == got.count()


def brute_leaders(rows):
    def over(a, b):
        w = min(a[5] + a[7], b[5] + b[7]) - max(a[5], b[5])
        h = min(a[6] + a[8], b[6] + b[8]) - max(a[6], b[6])
        if w <= 0 or h <= 0:
            return 0.0
        return w * h / (a[7] * a[8] + b[7] * b[8] - w * h)

    of = {}
    for i, r in enumerate(rows):
        if i not in of:
            of[i] = i
            for j in range(i + 1, len(rows)):
                if j not in of and over(r, rows[j]) > 0.5:
                    of[j] = i
    return of


def test_leaders_match_the_loop(spark):
    rng = np.random.default_rng(2)
    rows = [("d", i, "e", str(i), 1.0, *map(int, rng.integers(0, 25, 2)), 12, 12) for i in range(60)]
    got = {r.pos: r.leader for r in layout.leader_groups(spark.createDataFrame(rows, REGION)).collect()}
    assert got == brute_leaders(rows)
    with pytest.raises(ValueError):
        layout.vote(spark.createDataFrame(rows, REGION), "none")


def test_clause_tree_nests(spark):
    df = spark.createDataFrame([(1, "제1조 (가) 나\n① 다\n1호 라\n2호 마\n제2조 [바]"), (2, None), (3, "없음")], "doc_id long, text string")
    flat = clauses.clauses(clauses.text_lines(df))
    tree = {r.doc_id: r.articles for r in clauses.clause_tree(flat).collect()}
    assert set(tree) == {1} and [a.number for a in tree[1]] == ["제1조", "제2조"]
    assert [i.content for i in tree[1][0].paragraphs[0].items] == ["라", "마"] and tree[1][1].title == "바"
    bad = flat.alias("c").join(flat.alias("p"), "doc_id").where("c.level = 2 and p.level = 1 and c.article_no = p.article_no and c.paragraph_no = p.paragraph_no and p.pos > c.pos")
    assert bad.count() == 0


def test_batch_of_fields(spark):
    df = spark.createDataFrame([(1, {"보증금": "보즈금 1,000원", "기타": " "})], "id long, fields map<string, string>")
    r = fields.postprocess_batch(df).first().results
    assert r["보증금"].corrected == "보증금 1,000원" and r["보증금"].valid and not r["기타"].valid


def test_views(spark):
    df = spark.createDataFrame([(1, '{"lessor": {"name": "김"}, "terms": {"deposit": 5}}')], "doc_id long, v string").withColumn("lease", fields.parse_lease(F.col("v")))
    v = df.select(fields.korean_view(F.col("lease"), F.lit(0.98765), F.lit(None).cast("string")).alias("k")).first().k
    assert v["당사자"]["임대인"]["성명"] == "김" and v["금액"]["보증금"] == 5 and v["메타"]["신뢰도"] == 98.8 and v["메타"]["원본"] == ""
    zero = spark.range(1).select(fields.or_default(F.lit(0), F.lit(7)).alias("a"), fields.or_default(F.lit(""), F.lit("x")).alias("b"), fields.or_default(F.lit("y"), F.lit("x")).alias("c")).first()
    assert tuple(zero) == (7, "x", "y")
    assert spark.range(1).select(fields.validate_lease(F.lit(None).cast(df.schema["lease"].dataType)).alias("v")).first().v is None


def test_context_never_exceeds_its_budget(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i, "x" * int(rng.integers(0, 300))) for g in range(20) for i in range(12)]
    df = spark.createDataFrame(rows, "g int, i int, text string")
    parts = search.context(df, "g", "i", most=600)
    by = {r.g: r.n for r in parts.groupBy("g").agg(F.sum(F.length("part")).alias("n")).collect()}
    assert set(by) == set(range(20)) and max(by.values()) <= 600
    assert search.context_text(parts, "g").count() == 20


def test_cache_key_and_fifo(spark):
    k = spark.range(1).select(tx.cache_key(F.lit("q"), F.lit(3), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))).alias("k")).first().k
    assert k == "q|3|a=1,b=2"
    kept = search.cached(spark.range(250).withColumnRenamed("id", "inserted"))
    assert kept.count() == 100 and kept.agg(F.min("inserted")).first()[0] == 150


def test_extensions(spark):
    q = spark.createDataFrame([(1, "전세 갱신")], "query_id int, query string")
    assert [r["query"] for r in search.expand_queries(q, F.array(F.lit("v1"), F.lit("v2"))).collect()] == ["전세 갱신", "v1", "v2"]
    r = spark.range(1).select(
        rules.danger_score(F.lit("임차인은 권리를 포기한다. 확정일자")).alias("d"), rules.danger_score(F.lit("좋은 계약")).alias("e"), rules.domain(F.lit("상가 전세")).alias("f"), rules.domain(F.lit("?")).alias("g"),
        search.article_boost(F.lit(1.0), F.lit("제7조"), F.lit("제7조")).alias("h"), search.domain_penalty(F.lit(9.0), F.lit("tax"), F.lit("residential")).alias("i"),
    ).first()
    assert tuple(r) == (80, 0, "commercial", "general", 5.0, 4.0)
    words = spark.createDataFrame([("a@b.co", 1), ("집", 2)], "text string, x int")
    assert [w.x for w in privacy.masked_boxes(words).collect()] == [1]


def test_jobs(spark):
    reqs = spark.createDataFrame([("c1", 9), ("c2", 0)], "contract_id string, priority int")
    rows = jobs.submitted(reqs).collect()
    assert len({r.job_id for r in rows}) == 2 and sorted(r.priority for r in rows) == [1, 3] and {r.status for r in rows} == {"QUEUED"}
    fails = spark.createDataFrame([(1, 0), (2, 2), (3, 3)], "job_id int, attempt int")
    assert [tuple(r)[2:] for r in jobs.retried(fails).orderBy("job_id").collect()] == [("RETRYING", 10), ("RETRYING", 40), ("FAILED", None)]


def test_providers(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    got = {r.id: r for r in providers.call(df, "id", "v", providers.stored({"a": '{"conf": 0.4}'}), retries=1).collect()}
    assert got[1].output and got[2].output is None and "LookupError" in got[2].error and got[3].error is None
    conf = lambda o: tx.json_path(o, "conf").cast("double")
    best = {r.id: r.confidence for r in providers.with_retry_of_poor(df, "id", "v", providers.stored({"a": '{"conf": 0.4}', "b": '{"conf": 0.9}'}), providers.stored({"a": '{"conf": 0.7}', "b": "{}"}), conf).collect()}
    assert best == {1: 0.7, 2: 0.9, 3: 0.0}
    e = providers.call(df.where("id = 1"), "id", "v", providers.hashed_embedding(8)).select(providers.embedding(F.col("output")).alias("e")).first().e
    assert len(e) == 8 and sum(abs(x) for x in e) == 1
    a = spark.createDataFrame([("bad",), ('{"total_clauses": 2}',)], "o string").select(providers.analysis(F.col("o")).alias("a")).collect()
    assert a[0].a.total_clauses == 0 and a[0].a.risk_summary == dict.fromkeys(("Safety", "Caution", "Risk"), 0) and a[1].a.total_clauses == 2
    r = providers.Registry()
    r.add("x", providers.stored({}))
    assert r.get("y", "x") is r.get("x")
    with pytest.raises(KeyError):
        r.get("y")
    regions = spark.createDataFrame([("d", 0, "e", "b", 1.0, 30, 0, 15, 15), ("d", 1, "e", "a", 1.0, 0, 0, 15, 15)], REGION)
    assert providers.prompt_lines(regions).first().prompt == "[1] a\n[2] b"
    assert providers.rescaled(regions, 1.5).where("pos = 0").first().x == 20


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.png", bytearray(b"1")), ("b.txt", bytearray(b"2"))], "key string, content binary")
    assert files.write_contents(rows, str(tmp_path / "f")).count() == 2
    assert files.images(spark, str(tmp_path / "f")).count() == 1
    got = {r.key: r for r in files.contents(spark, spark.createDataFrame([("b.txt",), ("none",)], "key string"), str(tmp_path / "f")).collect()}
    assert bytes(got["b.txt"].content) == b"2" and got["none"].error
    assert files.exists(spark, str(tmp_path / "f" / "b.txt")) and files.delete(spark, str(tmp_path / "f" / "b.txt")) and not files.exists(spark, str(tmp_path / "f" / "b.txt"))
    path = str(tmp_path / "v")
    files.create_collection(spark, path)
    with pytest.raises(Exception):
        files.create_collection(spark, path)
    new = spark.createDataFrame([(1, [1.0, 0.0], "a", {"k": "v"})], "id bigint, embedding array<float>, content string, metadata map<string, string>")
    files.upsert_vectors(spark, path, new)
    files.upsert_vectors(spark, path, new.withColumn("content", F.lit("b")))
    assert spark.read.parquet(path).first().content == "b" and tuple(files.collection_info(spark, path).first()) == (1, 2)
    assert files.drop_collection(spark, path)
    assert files.setting(spark, "key", {"key": "e"}) == "e" and files.setting(spark, "key", {}, {"key": "f"}, "d") == "f" and files.setting(spark, "key", {}, None, "d") == "d"
    for form in ("parquet", "orc", "csv", "json"):
        files.write(spark.range(3), str(tmp_path / form), form)
        assert files.read(spark, str(tmp_path / form), form, "id bigint").count() == 3


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text('{"taskId": "t1", "userId": 4}\n{"task_id": "t2", "contract_text": "x"}\nnot json\n{"userId": 1}\n')
    good, bad = stream.parsed(stream.messages(spark, str(tmp_path / "in")))
    q = [stream.to_table(df, str(tmp_path / n), str(tmp_path / f"c{n}")) for n, df in (("good", stream.results(good, "task_id")), ("bad", stream.results(bad.withColumn("task_id", F.coalesce("task_id", F.lit("?"))), "task_id")))]
    for x in q:
        x.awaitTermination()
    rows = {r.key: json.loads(r.value) for r in spark.read.parquet(f"{tmp_path}/good/*").collect()}
    assert rows == {"t1": {"task_id": "t1", "user_id": 4}, "t2": {"task_id": "t2", "contract_text": "x"}}
    assert spark.read.parquet(f"{tmp_path}/bad/*").count() == 2


def test_stream_of_states_is_that_of_the_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(f"j{rng.integers(6)}", ["QUEUED", "ANALYZING", "COMPLETED"][i % 3], i) for i in range(60)]
    schema = "job_id string, status string, updated_at timestamp"
    for n in range(3):
        df = spark.createDataFrame(rows[n * 20 : n * 20 + 20], "job_id string, status string, t int").select("job_id", "status", F.timestamp_seconds("t").alias("updated_at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev"))
    q = stream.to_table(stream.states(events), str(tmp_path / "out"), str(tmp_path / "ck"), once=False)
    for _ in range(90):  # batches without data go on for the clock's sake, so that the stream never counts as done
        time.sleep(1)
        if q.lastProgress and (tmp_path / "out").exists() and stream.table_of(spark, str(tmp_path / "out")).agg(F.sum("events")).first()[0] == 60:
            break
    q.stop()
    got = {(r.job_id, r.status, r.events) for r in stream.table_of(spark, str(tmp_path / "out")).collect()}
    want = jobs.latest(spark.read.parquet(str(tmp_path / "ev")).withColumn("event_id", F.lit(0)))
    assert got == {(r.job_id, r.status, r.events) for r in want.collect()}


def test_stream_windows_and_failures(spark, tmp_path):
    ev = spark.range(100).select(F.timestamp_seconds(F.col("id") * 600).alias("ts"), (F.col("id") % 2).cast("string").alias("event_type"), F.lit(1.0).alias("value"), (F.col("id") % 3).alias("user_id"))
    ev.write.parquet(str(tmp_path / "ev"))
    src = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    q = stream.windowed(src).writeStream.format("memory").queryName("w1").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w1").agg(F.sum("n")).first()[0] == 100
    assert stream.sessions(ev, "15 minutes").count() == 100

    def broken(_):
        raise OSError("down")

    stream.with_retries(broken, str(tmp_path / "failed"), 1)(ev, 7)
    assert spark.read.parquet(str(tmp_path / "failed" / "*")).where("error like 'OSError%'").count() == 100
    c = stream.Consumer(lambda: stream.windowed(src).writeStream.format("memory").queryName("w2").outputMode("complete").start())
    assert c.start() is c.start()
    c.stop()
    assert c.query is None


def test_pixels():
    rgb = np.full((20, 20, 3), 200, np.uint8)
    rgb[5:9, 5:9] = (220, 20, 30)
    assert (pixels.without_red_stamp(rgb)[5:9, 5:9] == 255).all() and (pixels.without_red_stamp(rgb)[0, 0] == 200).all()
    page = np.full((200, 300), 255, np.uint8)
    page[50:53, :] = page[120:123, :] = 0
    page[:, 40:43] = page[:, 160:163] = page[:, 250:253] = 0
    assert pixels.table_cells(page) == [(41, 51, 120, 70), (161, 51, 90, 70)]
    lines = np.full((200, 300), 255, np.uint8)
    for y in range(20, 180, 20):
        x = np.arange(300)
        lines[np.clip(y + np.round(x * np.tan(np.radians(4))).astype(int), 0, 199), x] = 0
    assert abs(pixels.skew_angle(lines) - 4) <= 0.5 and pixels.skew_angle(pixels.deskewed(lines)) == 0
    flat = pixels.equalised(np.tile(np.arange(100, 130, dtype=np.uint8), (64, 2)))
    assert flat.min() < 100 and flat.max() > 130


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from("일이삼사오육칠팔구십백천만억조x"), max_size=8))
def test_korean_number_matches_a_loop(spark, chars):
    small, unit = "일이삼사오육칠팔구", dict(zip("십백천만억", (10, 100, 1000, 10_000, 100_000_000)))
    total, held = 0, 0
    for c in chars:
        if c in small:
            held = small.index(c) + 1
        elif c in unit:
            held = max(held, 1) * unit[c]
            if unit[c] >= 10_000:
                total, held = total + held, 0
    got = spark.createDataFrame([("".join(chars),)], "v string").select(tx.korean_number(F.col("v")).alias("n")).first().n
    assert got == (total + held or None)


def png(pixels, kind, filters):
    """A PNG file of rows of bytes."""
    import struct
    import zlib

    h, w = pixels.shape[:2]
    chunk = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
    step, raw, before = pixels.reshape(h, w, -1).shape[2], b"", np.zeros(w * pixels.reshape(h, w, -1).shape[2], int)
    for y in range(h):
        row = pixels[y].reshape(-1).astype(int)
        left, f = np.concatenate([np.zeros(step, int), row[:-step]]), filters[y % len(filters)]
        corner = np.concatenate([np.zeros(step, int), before[:-step]])
        if f == 4:
            p = left + before - corner
            near = np.stack([abs(p - left), abs(p - before), abs(p - corner)])
            guess = np.choose(near.argmin(0), [left, before, corner])
        else:
            guess = [0 * row, left, before, (left + before) // 2][f]
        raw += bytes([f]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        before = row
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_are_decoded(spark):
    rng = np.random.default_rng(0)
    grey, rgb, rgba = rng.integers(0, 256, (9, 7), dtype=np.uint8), rng.integers(0, 256, (9, 7, 3), dtype=np.uint8), rng.integers(0, 256, (9, 7, 4), dtype=np.uint8)
    assert (images.decode(png(grey, 0, [0, 1, 2, 3, 4])) == np.repeat(grey[..., None], 3, 2)).all()
    assert (images.decode(png(rgb, 2, [4, 3, 1])) == rgb).all() and (images.decode(png(rgba, 6, [2])) == rgba[..., :3]).all()
    assert (images.decode(b"P6\n7 9\n255\n" + rgb.tobytes()) == rgb).all() and (images.decode(b"P5 # note\n7 9 255\n" + grey.tobytes())[..., 0] == grey).all()
    rows = [(1, png(rgb, 2, [0])), (2, b"not an image"), (3, None), (4, png(rgb, 2, [0])[:60])]
    got = {r.id: r for r in images.decoded(spark.createDataFrame(rows, "id long, content binary"), "id", "content").collect()}
    assert (got[1].width, got[1].height, got[1].error) == (7, 9, None) and got[1].pixels == rgb.tobytes()
    assert got[2].error and got[4].error and got[3].pixels is None and got[3].error is None


def test_pages_are_cleaned_and_their_cells_found(spark):
    page = np.full((80, 120, 3), 255, np.uint8)
    page[[10, 40, 70], 10:110] = 0
    page[10:71, [10, 60, 109]] = 0
    page[50:60, 70:90] = (220, 10, 20)
    df = spark.createDataFrame([(1, png(page, 2, [1])), (2, b"x")], "id long, content binary")
    clean = {r.id: r for r in images.cleaned(df, "id", "content").collect()}
    assert (clean[1].width, clean[1].height) == (120, 80) and clean[2].error and np.frombuffer(clean[1].pixels, np.uint8).reshape(80, 120)[55, 80] > 200
    cells = sorted((r.x, r.y, r.w, r.h) for r in images.cells(df, "id", "content").collect())
    assert cells == [(10, 10, 50, 30), (10, 40, 50, 30), (60, 10, 49, 30), (60, 40, 49, 30)]


def test_from_object_to_lease(spark):
    """OCR words for one file, the parser's blocks for another, an answer that isn't a lease, a file that no one reads."""
    quad = lambda x, y: {"vertices": [{"x": x, "y": y}, {"x": x + 9, "y": y}, {"x": x + 9, "y": y + 9}, {"x": x, "y": y + 9}]}
    pages = json.dumps([{"width": 100, "height": 100, "words": [{"text": "임대인", "confidence": 0.9, "boundingBox": quad(1.0, 2.0)}, {"text": "홍길동", "confidence": 0.8, "boundingBox": quad(20.0, 3.0)}]}])
    box = [{"x": a, "y": b} for a, b in ((0.1, 0.1), (0.5, 0.1), (0.5, 0.2), (0.1, 0.2))]
    elements = json.dumps([{"category": "paragraph", "content": {"text": "보증금 1,000원"}, "coordinates": box}])
    answer = '```json\n{"lessor": {"name": "홍길동"}, "lessee": {"name": "김"}, "property": {"address": "서울"}, "terms": {"deposit": "1,000"}}\n```'
    ocr, parse = providers.stored({"a": pages}), providers.stored({"b": elements})
    model = providers.stored({"임대인 홍길동": answer, "보증금 1,000원": "sorry"})
    files = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "doc_id string, content string")
    got = {r.doc_id: r for r in documents.ocr_to_lease(files, ocr, parse, model).collect()}
    assert got["1"].success and got["1"].full_text == "임대인 홍길동" and [w.text for w in got["1"].words] == ["임대인", "홍길동"]
    assert json.loads(got["1"].validation)["is_valid"] and json.loads(got["1"].contract_data)["terms"]["deposit"] == 1000
    assert got["2"].full_text == "보증금 1,000원" and got["2"].words is None and "lessor.name" in json.loads(got["2"].validation)["warnings"]
    assert not got["3"].success and got["3"].full_text == ""


def test_regions_and_cells_read_again(spark):
    regions = spark.createDataFrame([("d", 0, "r0", 1, 2), ("d", 1, "r1", 3, 4)], "doc_id string, pos int, crop string, x int, y int")
    got = documents.region_engine(regions, providers.stored({"r0": " 가 ", "r1": " "})).collect()
    assert [(r.pos, r.text, r.confidence, r.engine) for r in got] == [(0, "가", 0.95, "trocr")]
    cells = spark.createDataFrame([("a", "1"), ("b", "2")], "cell_id string, content string")
    first = providers.stored({"1": '{"text": "x", "confidence": 0.9}', "2": '{"text": "y", "confidence": 0.3}'})
    second = providers.stored({"2": '{"text": "z", "confidence": 0.8}'})
    assert {(r.cell_id, r.text, r.confidence) for r in documents.cell_passes(cells, first, second).collect()} == {("a", "x", 0.9), ("b", "z", 0.8)}


def test_database_rows_are_read_and_changed_by_key(spark, tmp_path):
    """Spark's own Derby stands in for a database: updates of a batch change the rows that there are, and may be run again."""
    options = files.jdbc_options(f"jdbc:derby:{tmp_path}/db;create=true", "jobs", driver="org.apache.derby.jdbc.EmbeddedDriver")
    spark.createDataFrame([(i, "QUEUED", None) for i in range(20)], "job_id long, status string, result string").write.format("jdbc").options(**options).mode("overwrite").save()
    batch = spark.createDataFrame([(3, "COMPLETED", "{}"), (4, "FAILED", None), (99, "COMPLETED", "{}")], "job_id long, status string, result string")
    for _ in range(2):
        stream.jdbc_update(spark, options, "job_id")(batch)
    got = {r["job_id"]: (r["status"], r["result"]) for r in files.jdbc_read(spark, options, "job_id", 0, 20, 3).toDF("job_id", "status", "result").collect()}
    assert len(got) == 20 and got[3] == ("COMPLETED", "{}") and got[4] == ("FAILED", None) and got[5] == ("QUEUED", None)


def test_rows_are_sent_and_failures_counted(spark, tmp_path):
    def send(row):
        if row["id"] == 2:
            raise OSError("refused")
        (tmp_path / str(row["id"])).write_text("sent")

    failed = files.each_row(spark.range(4), send)
    assert failed == 1 and sorted(p.name for p in tmp_path.iterdir()) == ["0", "1", "3"]


def test_health_and_settings(spark, tmp_path):
    assert files.health(spark)["status"] == "healthy"
    path = tmp_path / "keys.yaml"
    path.write_text("# keys\nupstage:\n  api_key: 'abc'  # ours\nopenai_key: \"d e\"\nempty:\n")
    keys = files.yaml_settings(str(path))
    assert keys == {"upstage.api_key": "abc", "openai_key": "d e"}
    assert files.setting(spark, "openai_key", {}, keys) == "d e" and files.yaml_settings(str(tmp_path / "none.yaml")) == {}


def test_postings_give_the_scan_s_ranking(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Alpha {'beta ' * (i % 3)}gamma{i % 4} x{i}") for i in range(60)] + [(99, None)], "doc_id long, text string")
    search.write_postings(docs, str(tmp_path / "p"), 8)
    for query in (["beta"], ["alpha", "gamma1"], ["nothing"]):
        assert search.bm25_of_postings(spark, str(tmp_path / "p"), query, 7, 8).collect() == search.bm25(docs, query, 7).collect()


def test_blocks_of_queries_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.integers(-3, 4, 4)]) for i in range(80)] + [(100, None), (101, [0.0] * 4), (102, [1.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = v.where("id < 30 or id > 99").withColumnRenamed("id", "query_id")
    one = sorted(map(tuple, search.search(v, q, 3).collect()))
    monkeypatch.setattr(search, "QUERY_ROWS", 7)
    assert sorted(map(tuple, search.search(v, q, 3).collect())) == one and len(one) >= 80
    unit = {i: np.array(e) / np.linalg.norm(e) for i, e in rows if e and np.linalg.norm(e) > 0 and len(e) == 4}
    for query in (0, 7):
        if query in unit:
            best = sorted((-round(float(unit[query] @ u), 9), i) for i, u in unit.items())[:3]
            assert [(r[1], r[2]) for r in one if r[0] == query] == [(i, -s) for s, i in sorted(best, key=lambda b: b[1])] or {r[1] for r in one if r[0] == query} == {i for _, i in best}
    assert search.search(v, q.limit(0), 3).count() == 0


def test_vectors_are_replaced_by_a_pointer(spark, tmp_path):
    path = str(tmp_path / "c")
    files.create_collection(spark, path)
    row = lambda i, x: (i, [x], f"t{i}", {})
    columns = spark.read.parquet(files.current(spark, path)).schema
    for batch in ([row(1, 1.0), row(2, 2.0)], [row(2, 5.0)]):
        files.upsert_vectors(spark, path, spark.createDataFrame(batch, columns))
    got = {r[0]: r.embedding for r in spark.read.parquet(files.current(spark, path)).collect()}
    assert got == {1: [1.0], 2: [5.0]} and files.collection_info(spark, path).first()["points"] == 2


def test_the_first_in_are_the_first_out(spark):
    kept = search.cached(spark.range(250).withColumnRenamed("id", "inserted"))
    assert {r.inserted for r in kept.collect()} == set(range(150, 250))
    assert search.dedup_prefix(spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "doc_id long, text string"), F.col("doc_id")).count() == 3
