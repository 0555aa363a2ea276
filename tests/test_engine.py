"""Operators on small cases of their own: levels, evidence, ledger, sources, streams, search."""

import io
import itertools
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first()["v"]


# --- Text and levels


@pytest.mark.parametrize(
    ("raw", "want"),
    [("亚军金牌", "二等奖"), ("金牌亚军", "二等奖"), ("第二名三等", "二等奖"), ("省 部 级（冠军）", "省级一等奖"), ("４等奖", "4等奖"), ("国家励志奖学金", "国家励志奖学金"), ("hello 10", "hello10"), ("", ""), ("三等 第四名", "三等奖")],
)
def test_level_ties_go_by_the_given_order(spark, raw, want):
    from assayer.functions import levels as L

    clean = spark.createDataFrame([(raw,)], "r string").select(L.cleaned(F.col("r")).alias("t"))
    assert clean.select(L.level_of(F.col("t"))["canonical"].alias("c")).first()["c"] == want


def test_every_alias_leads_back_to_its_level(spark):
    from assayer.functions import levels as L

    spelt = spark.createDataFrame([("省级二等奖",), ("国际级特等奖",)], "level string").select("level", F.explode(L.level_aliases(F.col("level"))).alias("a"))
    again = spelt.select("level", L.level_of(F.col("a"))["canonical"].alias("c"))
    assert again.where("level <> c").count() == 0 and spelt.count() == 30 + 9


@pytest.mark.parametrize(("a", "b", "same"), [("\tab\t", "ab", True), ("a\u00a0\n\n b", "a\nb", True), ("ＡＢ", "AB", True), ("a b", "ab", False), (None, "", True)])
def test_content_hash_ignores_outer_space_of_any_script(spark, a, b, same):
    from assayer.functions.text import content_hash

    rows = spark.createDataFrame([(a, b)], "a string, b string").select(content_hash(F.col("a")).alias("x"), content_hash(F.col("b")).alias("y")).first()
    assert (rows["x"] == rows["y"]) == same


def test_keys_and_tokens_know_all_white_space(spark):
    from assayer.functions import text as T

    assert one(spark, T.norm_key(F.lit("A\u00a0B\u2003c（d）"))) == "abcd"
    assert one(spark, T.search_tokens(F.lit("Ab\u00a0c 12.5 省二等"))) == ["abc", "12.5", "省", "二", "等", "省二", "二等"]
    assert one(spark, T.numbers_unsupported(F.lit("得 8 分，共-3.5 与 1.2.3 和 9"), F.array(F.lit("8 or 09"), F.lit("-3.5")))) == ["9"]
    assert one(spark, T.in_order(F.lit("one two one"), F.array(F.lit("two"), F.lit("one")))) and not one(spark, T.in_order(F.lit("one two"), F.array(F.lit("two"), F.lit("one"))))
    assert [one(spark, T.chinese_number(F.lit(x))) for x in ("十", "二十", "十五", "九十九", "一百", "二百", "两", "零", "一二")] == [10, 20, 15, 99, 100, None, 2, 0, None]


def test_pseudonyms_are_hmacs(spark):
    import hashlib
    import hmac

    from assayer.functions.text import pseudonym

    for key in (b"k", b"a long key " * 20):
        assert one(spark, pseudonym(F.lit("学号 7"), key)) == hmac.new(key, "学号 7".encode(), hashlib.sha256).hexdigest()[:24]


# --- Evidence


def test_merged_cells_keep_their_own_values(spark):
    from assayer.operators.evidence import fill_merges

    cells = [("s", r, c, v) for r, row in enumerate([["a", "b", "x"], [None, None, "x"], ["q", None, None], ["q", "q", None]]) for c, v in enumerate(row)]
    frame = spark.createDataFrame(cells + [("s", 9, 9, "q"), ("s", 9, 9, "q")], "sheet string, row long, col long, value string")
    merges = spark.createDataFrame([("s", 0, 0, 1, 1), ("s", 2, 0, 2, 2)], "sheet string, r0 long, c0 long, r1 long, c1 long")
    got = sorted((r["row"], r["col"], r["value"]) for r in fill_merges(frame, merges).collect() if r["value"] is not None)
    assert got == sorted([(0, 0, "a"), (0, 1, "b"), (0, 2, "x"), (1, 0, "a"), (1, 1, "b"), (1, 2, "x"), (2, 0, "q"), (2, 1, "q"), (2, 2, "q"), (3, 0, "q"), (3, 1, "q"), (9, 9, "q"), (9, 9, "q")])
    with pytest.raises(ValueError, match="overlap"):
        fill_merges(frame, merges.unionByName(spark.createDataFrame([("s", 1, 1, 2, 3)], merges.schema)))


def test_near_pairs_by_brute_force(spark):
    from assayer.operators.evidence import near_pairs

    rnd = random.Random(4)
    centres = [rnd.getrandbits(63) for _ in range(5)]
    hashes = sorted({c ^ sum(1 << b for b in rnd.sample(range(63), rnd.randrange(5))) for c in centres for _ in range(30)})
    rows = spark.createDataFrame(list(enumerate(hashes)) + [(999, None), (500, hashes[0])], "id long, h long")
    got = sorted((r["a"], r["b"], r["distance"]) for r in near_pairs(rows, "id", "h").collect())
    assert got == sorted((i, j, (x ^ y).bit_count()) for (i, x), (j, y) in itertools.combinations(enumerate(hashes), 2) if (x ^ y).bit_count() <= 3)


def test_hex_distance_and_invalid_hashes(spark):
    from assayer.operators.evidence import hamming_hex

    rows = spark.createDataFrame([("ff00", "FF01"), ("ff", "fff"), ("zz", "00"), (None, "00"), ("", "")], "a string, b string")
    assert [r[0] for r in rows.select(hamming_hex(F.col("a"), F.col("b"))).collect()] == [1, None, None, None, None]


# --- Ledger


def test_conflicting_groups_keep_the_best_set(spark):
    """Random conflict graphs: the groups that go are those outside the best conflict-free set, by full enumeration."""
    from assayer.operators.ledger import exclusive

    rnd = random.Random(6)
    names = [f"g{k}" for k in range(7)]
    edges = {frozenset(rnd.sample(names, 2)) for _ in range(8)}
    pairs = [(a, b) for e in edges for a, b in itertools.permutations(e)]
    winners = [(s, g, rnd.randrange(1, 6) * 100) for s in range(40) for g in names if rnd.random() < 0.7]
    got = {(r["student_id"], r["grp"]) for r in exclusive(spark.createDataFrame(winners, "student_id long, grp string, score long"), spark.createDataFrame(pairs, "a string, b string")).collect()}
    want = set()
    for s in range(40):
        mine = {g: x for i, g, x in winners if i == s}
        left = set(mine)
        while left:
            part, grow = set(), {min(left)}
            while grow:
                part |= grow
                grow = {h for h in mine if any(frozenset((g, h)) in edges for g in part)} - part
            left -= part
            sets = [c for n in range(1, len(part) + 1) for c in itertools.combinations(sorted(part), n) if not any(frozenset(e) in edges for e in itertools.combinations(c, 2))]
            best = min(sets, key=lambda c: (-sum(mine[g] for g in c), -max(mine[g] for g in c), c))
            want |= {(s, g) for g in part - set(best)}
    assert got == want


# --- Search


def test_hash_embeddings_by_definition(spark):
    import hashlib

    from assayer.operators.retrieval import hash_embedding

    tokens = ["a", "b", "a", "省"]
    want = np.zeros(16)
    for t in tokens:
        digest = hashlib.blake2b(t.encode(), digest_size=8).digest()
        want[int.from_bytes(digest[:4], "big") % 16] += 1 if digest[4] % 2 else -1
    got = one(spark, hash_embedding(F.array(*map(F.lit, tokens)), 16))
    assert np.allclose(got, want / np.linalg.norm(want))
    assert one(spark, hash_embedding(F.array().cast("array<string>"), 16)) == [0.0] * 16


def test_best_of_breaks_ties_by_id_and_drops_what_is_not_positive():
    from assayer.operators.retrieval import best_of

    scores = np.array([[1.0, 0.0], [2.0, -1.0], [1.0, 0.0], [1.0, 0.5]])
    query, ids, values = best_of(scores, np.array([7, 9, 3, 5]), np.array([10, 20]), 3)
    assert list(zip(query, ids, values, strict=True)) == [(10, 9, 2.0), (10, 3, 1.0), (10, 5, 1.0), (20, 5, 0.5)]


def test_search_in_blocks_of_queries(spark, monkeypatch):
    from assayer.operators import retrieval as R

    rnd = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, rnd.normal(size=4).tolist()) for i in range(50)], "id long, v array<double>").repartition(3)
    asked = rows.where("id % 5 = 0").select(F.col("id").alias("query"), "v")
    whole = sorted(map(tuple, R.vectors(rows, asked, 4).collect()))
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    monkeypatch.setattr(R, "CELLS", 7)
    assert sorted(map(tuple, R.vectors(rows, asked, 4).collect())) == whole and len(whole) == 40
    assert R.vectors(rows, asked.where("false"), 4).count() == 0


# --- Metrics


def test_order_statistics_by_brute_force(spark):
    from assayer.operators.metrics import order_statistics

    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), rnd.choice([None, *range(9)])) for _ in range(200)] + [("c", 4)]
    got = {r["g"]: r["p"] for r in order_statistics(spark.createDataFrame(rows, "g string, v long").repartition(5), "g", "v", {"p": lambda n: F.ceil(n * 0.9)}).collect()}
    for g in "abc":
        values = sorted(v for h, v in rows if h == g and v is not None)
        assert got[g] == values[-(-len(values) * 9 // 10) - 1]


# --- Sources


def workbook() -> bytes:
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="rules" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>类别</t></si><si><r><t>等</t></r><r><t>级</t></r></si></sst>")
        cells = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>赛事</t></is></c><c r="B3"><v>8.5</v></c><c r="C3" t="b"><v>1</v></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>{cells}</sheetData><mergeCells><mergeCell ref="A1:A2"/></mergeCells></worksheet>')
    return out.getvalue()


def test_workbooks_and_documents_are_rows(spark, tmp_path):
    from assayer.sources.workbook import read_documents, read_workbooks

    (tmp_path / "a.xlsx").write_bytes(workbook())
    cells, merges = read_workbooks(spark, str(tmp_path / "*.xlsx"))
    got = {(r["row"], r["col"]): r["value"] for r in cells.collect()}
    assert len(got) == 9 and {k: v for k, v in got.items() if v} == {(1, 1): "类别", (1, 2): "等级", (3, 1): "赛事", (3, 2): "8.5", (3, 3): "TRUE"}
    assert [(r["sheet"], r["r0"], r["c0"], r["r1"], r["c1"]) for r in merges.collect()] == [("rules", 1, 1, 2, 1)]
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>one </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    assert [(r["kind"], r["block"], r["row"], r["col"], r["text"]) for r in read_documents(spark, str(tmp_path / "*.docx")).collect()] == [("paragraph", 0, 0, 0, "one two"), ("table", 2, 0, 0, "x")]


def test_csv_round_trip_and_repeated_keys(spark, tmp_path):
    from assayer.sources import tables as S

    rows = spark.createDataFrame([("s1", '=1+1 "x"', "8分"), ("s2", "line\nbreak,", ""), ("s3", None, "7")], "student_id string, note string, points string").coalesce(1)
    S.write_csv(rows, str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbfstudent_id")
    again = S.read_csv(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.withColumn("points", F.nullif("points", F.lit(""))).collect()))
    assert sorted(tuple(r) for r in S.truths(again, ["student_id"], "points").collect()) == [("s1", 8.0), ("s3", 7.0)]
    with pytest.raises(ValueError, match="repeated key"):
        S.truths(again.unionByName(again), ["student_id"], "points")


# --- Streams


@pytest.fixture
def stream(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").where("user_id < 20")
    for k in range(2):
        events.where(f"event_id % 2 = {k}").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), events


def drain(frame, name):
    query = frame.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return frame.sparkSession.table(name).collect()


def test_streams_agree_with_batches(spark, stream):
    from assayer.operators.versions import fold
    from assayer.streaming import windows as W

    live, events = stream
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    live = live.withColumn("ts", F.col("ts").cast("timestamp"))
    found = drain(W.first_seen(live, ["user_id", "event_type"], delay="400 days"), "firsts")
    assert len(found) == events.select("user_id", "event_type").distinct().count()
    counts = drain(W.tumbling_counts(live, "ts", "event_type", "1 day", "400 days"), "counts")
    assert counts == []  # nothing is final before the watermark has passed
    moves = [("pending", "click", "in_progress"), ("in_progress", "purchase", "resolved")]
    task = lambda frame: frame.select(F.col("user_id").alias("task"), "event_id", "ts", F.col("event_type").alias("event"))
    got = drain(W.workflow_states(task(live), "pending", moves), "states")
    assert len(got) == events.count()
    for user in {r["task"] for r in got}:
        revisions = [r["revision"] for r in got if r["task"] == user]
        assert max(revisions) <= 2 and sum(r["legal"] for r in got if r["task"] == user) == max(revisions)
    assert fold(task(events), "task", ["ts", "event_id"], "pending", moves).count() == events.count()


# --- Rules matched one to one


def matched_by_brute_force(gold, predicted):
    pairs = []
    for case, g, fields in gold:
        for other, p, values in predicted:
            same = sum(a == b and a is not None for a, b in zip(fields, values, strict=False))
            if case == other and case is not None and same:
                pairs.append((-round(same / len(fields), 6), g, p, case))
    used, out = set(), []
    for agreement, g, p, case in sorted(pairs):
        if (case, "g", g) not in used and (case, "p", p) not in used:
            used |= {(case, "g", g), (case, "p", p)}
            out.append((case, g, p, -agreement))
    return sorted(out)


@pytest.mark.parametrize("subsets", [64, 1])
def test_greedy_matches_by_brute_force(spark, monkeypatch, subsets):
    """Rules of one to five fields, some null, equal ids and null cases, found by every choice of places or by blocks of them."""
    from assayer.operators import metrics

    monkeypatch.setattr(metrics, "SUBSETS", subsets)
    rnd = random.Random(7)
    rule = lambda at: (rnd.choice([1, 2, 3, None]), at, [rnd.choice(["a", "b", "c", None]) for _ in range(rnd.randrange(1, 6))])
    gold, predicted = [rule(k) for k in range(150)], [rule(k) for k in range(130)] + [(3, 5, ["a", "b", "c"]), (4, 1, ["a"])]
    frames = [spark.createDataFrame(rows + [(2, 900 + len(rows), None)], "case long, id long, fields array<string>").repartition(3) for rows in (gold, predicted)]
    got = sorted((r["case"], r["g"], r["p"], r["agreement"]) for r in metrics.greedy_matches(*frames, "case").collect())
    assert got == matched_by_brute_force(gold, predicted)
    assert metrics.greedy_matches(frames[0].where("false"), frames[1], "case").count() == 0


def test_greedy_matches_list_no_pairs():
    """20,000 rules on each side that all agree in a field, 400 million pairs, are matched in their order."""
    import pyarrow as pa

    from assayer.operators.metrics import _match

    n = 20_000
    ids, fields = pa.array(range(n)), [pa.array([["same", f"{side}{k}"] for k in range(n)]) for side in "gp"]
    g, p, agreement = _match(ids, fields[0], ids, fields[1])
    assert g.equals(ids) and p.equals(ids) and set(agreement.to_pylist()) == {0.5}
