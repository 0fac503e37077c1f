from ledgermesh.constants import BITS
from ledgermesh.functions import address, keys, phonetic, similarity, text
from ledgermesh.operators import blocking, decide, evaluate, features, rules, validate
from ledgermesh.sources import tables
from ledgermesh.streaming.arrivals import stream_matches
from pyspark.sql import functions as F


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


def test_text_cases(spark):
    assert one(spark, "général", text.fold) == "general"
    assert one(spark, "Macy's", text.norm_text) == "macys"
    assert one(spark, "A & B", text.norm_text) == "a and b"
    assert one(spark, None, text.norm_text) == ""
    assert one(spark, "re1iable", text.canon_token) == "reliable"
    assert one(spark, "academylimited", text.unglue_legal) == "academy"
    assert one(spark, "limitedlimited", text.unglue_legal) is None
    assert one(spark, "zinc", text.unglue_legal) == "zinc"
    assert one(spark, "ashishserviceslimited", lambda c: text.strip_glued(c, 4)) == "ashishservices"
    assert one(spark, "solquo dba delhi producer", text.dba_parts) == ["solquo", "delhi producer"]
    assert one(spark, "plain name", text.dba_parts) == []
    assert one(spark, "private laxmi foods limited", text.name_tokens) == ["laxmi", "foods"]
    assert one(spark, "7 eleven", text.name_tokens) == ["eleven"]
    assert one(spark, "a1pha alpha", text.name_tokens) == ["alpha"]
    assert one(spark, "private limited", text.name_tokens) == ["private", "limited"]
    assert one(spark, "", text.name_tokens) == []
    assert one(spark, "taco", lambda c: text.strip_glued(c, 4)) == "taco"


def test_address_cases(spark):
    def parsed(value):
        p = address.parse_tokens(address.address_tokens(F.col("x")))
        r = spark.createDataFrame([(value,)], "x string").select(p.alias("p")).select("p.*", address.street_token(F.col("p.tokens"), F.col("p.hnum")).alias("street")).first()
        return r.hnum, r.postcode, r.street

    assert parsed("12 bis rue de la paix 75002 paris") == ("12", "75002", "paix")
    assert parsed("near sbi atm pune 411 001")[:2] == (None, "411001")
    assert parsed("005319 maple rd")[0] == "5319"
    assert parsed("75002") == ("75002", None, None)
    assert one(spark, "217nd sixth st", address.address_tokens) == ["217", "6", "st"]
    assert parsed("") == (None, None, None)


def test_keys_of_reordered_names(spark):
    rows = [("S1-1", 1, "private laxmi foods limited", "7 mg road", "India"), ("S2-1", 2, "laxmi foods private limited", "", None), ("S3-1", 3, None, None, "india")]
    df = spark.createDataFrame(rows, "entity_id string, source int, business_name string, business_address string, country string")
    got = {r.entity_id: r for r in blocking.keyed_records(df).collect()}
    a, b = got["S1-1"], got["S2-1"]
    assert a.k_sorted == b.k_sorted == "food laxmi" and a.k_compact == b.k_compact == ["laxmifoods"] and a.k_pre == "laxmifoo" and a.k_suf == "xmifoods" and a.k_phon == b.k_phon
    assert all(getattr(got["S3-1"], c) is None for c in ("k_compact", "k_sorted", "k_rare1", "k_addr", "k_phon", "k_nameaddr"))
    assert b.country == ""
    assert blocking.long_keys(blocking.keyed_records(df)).where("entity_id = 'S3-1'").count() == 0
    assert keys.normalised(df).count() == 3


def test_caps_drop_whole_blocks(spark):
    rows = [("S1-1", 1, "", 0, "k"), ("S1-2", 1, "", 0, "m")] + [(f"S2-{i}", 2, "", 0, "k") for i in range(3)] + [(f"S3-{i}", 3, "", 0, "m") for i in range(4)]
    df = spark.createDataFrame(rows, "entity_id string, source int, country string, bit int, key string")
    got = {(r.s1_id, r.cand_id, r.mask) for r in blocking.candidates(df, {"compact": 3}).collect()}
    assert got == {("S1-1", f"S2-{i}", 1) for i in range(3)}
    stats = blocking.block_stats(df, {"compact": 3}).first()
    assert (stats.blocks, stats.dropped_blocks, stats.dropped_vendor_records, stats.largest) == (2, 1, 4, 4)
    assert {(r.source1_entity_id, r.candidate_entity_ids) for r in blocking.grouped(df.where("source = 1"), blocking.candidates(df, {"compact": 3})).collect()} == {("S1-1", "S2-0,S2-1,S2-2"), ("S1-2", "")}


def test_metaphone():
    cases = {"knight": "NT", "phone": "FN", "school": "SKL", "xylo": "SL", "wright": "RT", "judge": "JJ", "chia": "X", "lamb": "LM", "laugh": "LF", "sign": "SN", "city": "ST", "science": "SNS", "match": "MX", "edge": "EJ", "": ""}
    assert {w: phonetic.metaphone(w) for w in cases} == cases


def test_similarities():
    s = similarity
    assert s.indel_ratio("", "") == 100 and s.indel_ratio("ab", "ab") == 100 and s.indel_ratio("abc", "abd") == 200 * 2 / 6
    assert s.lcs_length("AGGTAB", "GXTXAYB") == 4
    assert s.token_set_ratio("a b c", "c b") == 100 and s.token_set_ratio("", "x") == 0 and s.token_sort_ratio("b a", "a b") == 100
    assert s.partial_ratio("abc", "xxabcxx") == 100 and s.partial_ratio("", "") == 100 and s.partial_ratio("abcd", "zzabzz") == s.partial_ratio("zzabzz", "abcd")
    assert abs(s.jaro_winkler("MARTHA", "MARHTA") - 0.961111) < 1e-5 and s.jaro_winkler("", "x") == 0


def test_jaro_winkler_equals_sql():
    import random

    import duckdb

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 30)))
    rows = [("zorb old gear private limited", "zorb dba old gear"), ("", ""), ("", "a"), ("a", "a")]
    for _ in range(3000):
        a = word()
        rows.append((a, "".join(r.choice("abcdefgh ") if r.random() < 0.2 else c for c in a)[: r.randint(0, 30)]))
        rows.append((a, word()))
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, a VARCHAR, b VARCHAR)")
    con.execute("INSERT INTO t SELECT unnest(?), unnest(?), unnest(?)", [list(range(len(rows))), [a for a, _ in rows], [b for _, b in rows]])
    want = [x for (x,) in con.execute("SELECT jaro_winkler_similarity(a, b) FROM t ORDER BY i").fetchall()]
    got = [similarity.jaro_winkler(a, b, both_empty=0.0) for a, b in rows]
    assert max(abs(x - y) for x, y in zip(got, want, strict=True)) < 1e-12
    assert [(x >= 0.9, x < 0.7) for x in got] == [(x >= 0.9, x < 0.7) for x in want]
    assert similarity.jaro_winkler("", "") == 1.0


def brute_partial(a, b):
    short, long = sorted((a, b), key=len)
    m = len(short)
    return max(similarity.indel_ratio(short, long[max(0, e - m) : e]) for e in range(1, len(long) + m)) if m else 0.0


def test_partial_ratio_is_the_best_window():
    import random

    r = random.Random(1)
    for _ in range(400):
        a, b = ("".join(r.choice("abcd ") for _ in range(r.randint(1, 12))) for _ in range(2))
        if len(a) != len(b):
            assert abs(similarity.partial_ratio(a, b) - brute_partial(a, b)) < 1e-9, (a, b)


def test_batch_scores_equal_the_plain_functions():
    import random

    r = random.Random(6)
    text = lambda: "".join(r.choice("abcdé日 ") for _ in range(r.choice([0, 1, 3, 9, 20, 63, 64, 65, 90])))
    a, b = ([text() for _ in range(400)] for _ in range(2))
    for many, one in ((similarity.partial_ratios, similarity.partial_ratio), (similarity.indel_ratios, similarity.indel_ratio), (similarity.jaro_winklers, similarity.jaro_winkler)):
        for x, y in ((a, b), (a, [t[::-1] for t in a]), (a, [t[2:] + "b" for t in a])):
            assert list(many(x, y)) == [one(p, q) for p, q in zip(x, y, strict=True)]


def test_shared_scores_equal_the_batch_forms():
    import random

    r = random.Random(7)
    wide = "".join(chr(200 + i) for i in range(900))
    text = lambda: "".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 3, 9, 20, 40, 63, 64, 65, 90])))
    for alphabet in ("abcdé 1", "ab ", "日b\t c", wide):
        a = [text() for _ in range(300)]
        b = [x[r.randrange(len(x) + 1) :] + text() if i % 2 else " ".join(reversed(x.split(" "))) for i, x in enumerate(a)]
        got = similarity.pair_scores(a + a, b + b, tuple(similarity.KINDS))
        for kind, many in similarity.KINDS.items():
            assert got[kind].tolist() == list(many(a, b)) * 2, kind
    assert [len(v) for v in similarity.pair_scores([], [], ("ratio", "partial")).values()] == [0, 0]


def test_all_scores_of_a_pair_take_one_call(spark):
    rows = spark.createDataFrame([("ann lee inc", "lee ann", "ann lee", "lee ann", "1 road", "2 road"), ("x", "y", "x", "y", "1 road", "")], "n1 string, n2 string, c1 string, c2 string, a1 string, a2 string")
    out = features.scored_features(rows)
    assert out.columns == [*rows.columns, *("n_ratio n_tset n_tsort n_partial n_jw core_ratio core_tset core_partial a_tset a_ratio a_partial".split())]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("score(") == 1
    one, two = out.orderBy("n1").collect()
    assert (one.n_tset, one.n_tsort, one.core_tset) == (100.0, similarity.token_sort_ratio("ann lee inc", "lee ann"), 100.0)
    assert (one.a_tset, one.a_ratio, one.a_partial) == tuple(f("1 road", "2 road") for f in (similarity.token_set_ratio, similarity.indel_ratio, similarity.partial_ratio))
    assert (two.a_tset, two.a_ratio, two.a_partial, two.n_jw) == (None, None, None, 0.0)


def test_scoring_is_dealt_to_all_tasks(spark):
    pairs = spark.createDataFrame([(f"S1-{i % 9}", f"S2-{i}", 1) for i in range(60)], "s1_id string, cand_id string, mask int")
    side = lambda ids: spark.createDataFrame([(i, f"name {i}", "1 road", "1", "2") for i in ids], "entity_id string, name_norm string, address_norm string, hnum string, postcode string")
    sides = side([f"S1-{i}" for i in range(9)]), side([f"S2-{i}" for i in range(60)]).withColumn("source", F.lit(2))
    out = features.build_features(pairs.withColumn("source", F.lit(2)), sides[0], sides[1].drop("source"))
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString() and out.count() == 60


def test_f05_example(spark):
    ref = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "entity_id string")
    truth = spark.createDataFrame([("S1-1", "S2-47, S3-812"), ("S1-2", ""), ("S1-3", None)], "source1_entity_id string, matched_entity_ids string")
    pred = spark.createDataFrame([("S1-1", "S2-47"), ("S1-1", "S2-193"), ("S1-1", "S3-812"), ("S1-3", "S2-1")], "s1_id string, cand_id string")
    rows = evaluate.per_reference(pred, evaluate.truth_pairs(truth), ref).withColumn("f", F.round(evaluate.f05(F.col("tp"), F.col("np"), F.col("nt")), 3))
    assert {r.entity_id: r.f for r in rows.collect()} == {"S1-1": 0.714, "S1-2": 1.0, "S1-3": 0.0}


def test_rules_and_one_owner(spark):
    bit = lambda *names: sum(1 << BITS[n] for n in names)
    pairs = spark.createDataFrame([("S1-2", "S2-1", bit("addrname")), ("S1-1", "S2-1", bit("addrname", "addr")), ("S1-3", "S2-2", bit("compact", "numname")), ("S1-4", "S2-3", bit("sorted"))], "s1_id string, cand_id string, mask int")
    took = lambda rule, **k: {(r.s1_id, r.cand_id) for r in rules.predict(pairs, rule, **k).collect()}
    assert took("R1") == {("S1-2", "S2-1"), ("S1-1", "S2-1")} and took("R1", one_owner=True) == {("S1-1", "S2-1")}
    assert ("S1-3", "S2-2") in took("R3") and took("R5") == set()


def test_tuning_prefers_the_first_of_equals(spark):
    preds = spark.createDataFrame([("S1-1", "S2-1", 0.9), ("S1-1", "S2-2", 0.2), ("S1-2", "S2-1", 0.6)], "s1_id string, cand_id string, p double")
    truth = spark.createDataFrame([("S1-1", "S2-1")], "s1_id string, cand_id string")
    ref = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    assert decide.tune(preds, truth, ref) == (False, 0.7, 0.7)
    assert decide.decide(preds, 0.5, one_owner=True).collect() == [("S1-1", "S2-1", 0.9)]


def test_tables_round_trip(spark, tmp_path):
    path = f"{tmp_path}/in.tsv"
    with open(path, "w") as f:
        f.write('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"Q" Inc\t\tUS\nS1-2\tshort\n')
    got = [tuple(r) for r in tables.read_source(spark, path, 1).orderBy("entity_id").collect()]
    assert got == [("S1-1", '"Q" Inc', "", "US", 1), ("S1-2", "short", "", "", 1)]
    out = spark.createDataFrame([("S1-1", "S2-1,S3-1"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string")
    tables.write_tsv(out, f"{tmp_path}/out", ("source1_entity_id",), one_file=True)
    part = next(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    assert part.read_text() == "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\n"
    rows = spark.range(50).selectExpr("concat('S1-', id) AS s1_id", "id")
    tables.write_missing_parts(rows, f"{tmp_path}/parts", 4)
    tables.write_missing_parts(rows, f"{tmp_path}/parts", 4)
    assert spark.read.parquet(f"{tmp_path}/parts").count() == 50
    calls = []
    compute = lambda: (calls.append(1), spark.range(3))[1]
    assert [tables.frequency_cache(compute, f"{tmp_path}/df", spark).count() for _ in range(2)] == [3, 3] and len(calls) == 1
    tables.write_json({"a": [1]}, f"{tmp_path}/x.json")
    assert tables.read_json(f"{tmp_path}/x.json") == {"a": [1]} and tables.markdown_table(spark.range(1)) == "| id |\n|---|\n| 0 |"


def test_validators_differ_on_blank_items(spark):
    table = spark.createDataFrame([("S1-1", "S2-1,,S3-1")], "source1_entity_id string, matched_entity_ids string")
    ref = spark.createDataFrame([("S1-1",)], "entity_id string")
    count = lambda strict: {r["check"]: r["n"] for r in validate.findings(table, "matched_entity_ids", ref, strict=strict).collect()}["wrong_prefix"]
    assert (count(True), count(False)) == (1, 0)
    assert validate.header_problem("Source1_Entity_ID\tmatched_entity_ids\n", "matched_entity_ids", exact=False) is None
    assert validate.header_problem("a\tb", "matched_entity_ids") is not None
    assert validate.verdict(validate.findings(table, "matched_entity_ids", ref)) == (True, [])


def test_stream_of_vendor_records(spark, tmp_path):
    schema = "entity_id string, source int, business_name string, business_address string, country string"
    ours = spark.createDataFrame([("S1-1", 1, "laxmi foods limited", "", "IN")], schema)
    vendor = spark.createDataFrame([("S2-1", 2, "laxmi foods pvt ltd", "", "IN"), ("S2-2", 2, "other things", "", "IN")], schema)
    both = blocking.long_keys(blocking.keyed_records(ours.unionByName(vendor)))
    vendor.write.parquet(f"{tmp_path}/in")
    none = spark.createDataFrame([], "token string, df long")
    got = []
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = stream_matches(stream, both.where("source = 1"), blocking.block_sizes(both).drop("n"), none, none, lambda rows, _: got.extend((r.s1_id, r.cand_id) for r in rows.collect()), f"{tmp_path}/state")
    q.awaitTermination(120)
    assert got == [("S1-1", "S2-1")]


def test_views_with_parameters_and_saved_tables(spark):
    rows = spark.createDataFrame([("S1-1", "US"), ("S1-2", "IN")], "s1_id string, country string")
    tables.register_views(ref=rows)
    assert [r.s1_id for r in spark.sql("SELECT s1_id FROM ref WHERE country = :c", args={"c": "IN"}).collect()] == ["S1-2"]
    tables.save_table(rows, "ledgermesh_saved", 4)
    try:
        assert spark.table("ledgermesh_saved").count() == 2
        plan = spark.table("ledgermesh_saved").groupBy("s1_id").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        spark.sql("DROP TABLE ledgermesh_saved")


def test_batch_scores_equal_the_plain_ones():
    import random

    import pytest
    from ledgermesh.functions import similarity as sim

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdé 1") for _ in range(r.choice([0, 1, 3, 9, 40, 90, 200])))
    a = [word() for _ in range(250)]
    b = [x[r.randrange(len(x) + 1) :] + word() if r.random() < 0.5 else word() for x in a]
    for one, many in ((sim.indel_ratio, sim.indel_ratios), (sim.token_sort_ratio, sim.token_sort_ratios), (sim.token_set_ratio, sim.token_set_ratios), (sim.partial_ratio, sim.partial_ratios)):
        assert many(a, b).tolist() == pytest.approx([one(x, y) for x, y in zip(a, b, strict=True)], abs=1e-9)
        assert len(many([], [])) == 0


def test_longest_common_subsequence_equals_the_table():
    import random

    from ledgermesh.functions import similarity as sim

    r = random.Random(6)
    for _ in range(80):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 90))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for c in a:
            new = [0]
            for j, d in enumerate(b):
                new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
            row = new
        n = len(a) + len(b)
        assert abs(sim.indel_ratios([a], [b])[0] - (200.0 * row[-1] / n if n else 100.0)) < 1e-9


def test_words_lose_any_number_of_glued_forms(spark):
    from ledgermesh.functions import text as T
    from pyspark.sql import functions as F

    row = spark.sql("SELECT :a AS a", args={"a": "acme" + "ltd" * 30}).select(T.unglue_legal(F.col("a")).alias("x")).first()
    assert row.x == "acme"


def test_reports_are_whole_and_fine_grid_is_clamped(spark):
    from ledgermesh.operators import decide, validate
    from ledgermesh.sources import tables

    assert tables.markdown_table(spark.range(1500)).count("\n") == 1501
    assert min(tb for _, _, tb in decide.fine_grid(False, 0.3, 0.05)) == 0.05
    lines = spark.createDataFrame([("a\tb",), ("broken",), (" ",), ("x\t",)], "value string")
    assert [r.value for r in validate.malformed(lines).collect()] == ["broken"]
