import copy

import pytest
from pyspark.sql import functions as F

from tidemark.functions import pii
from tidemark.operators import cards as C
from tidemark.operators import draft, evaluate, lifecycle, packs, planner, profile
from tidemark.plans import demo


def broken(change):
    doc = copy.deepcopy(demo.DOCUMENT)
    change(doc)
    return packs.parse(doc)


def test_demo_pack_is_valid_and_round_trips(spark, tmp_path):
    p = demo.pack()
    assert packs.is_valid(spark, p)
    packs.save(p, str(tmp_path / "p.json"))
    assert packs.load(str(tmp_path / "p.json")) == p


@pytest.mark.parametrize("change, kind", [
    (lambda d: d["metrics"][0]["required_tables"].append("gone"), "unknown_tables"),
    (lambda d: d["metrics"].append(dict(d["metrics"][0])), "duplicate_id"),
    (lambda d: d["policies"][0]["blocked_columns"].clear(), "pii_not_blocked"),
    (lambda d: d["value_dictionaries"].append({"id": "v", "table": "customer", "column": "c_name", "values": [{"value": "x", "label": "x", "count": 1}], "status": "draft"}), "pii_values_stored"),
    (lambda d: d["verified_queries"][0]["related_terms"].append("term.none"), "unknown_business_terms"),
])
def test_findings(spark, change, kind):
    assert kind in {r.kind for r in packs.validate(spark, broken(change)).collect()}


def test_unknown_sections_and_fields_are_errors():
    for change in (lambda d: d.update(extra=1), lambda d: d["metrics"][0].update(extra=1), lambda d: d.pop("id"), lambda d: d["metrics"][0].pop("id")):
        with pytest.raises(packs.PackError):
            broken(change)


def test_cards_hide_values_of_unsafe_columns_and_personal_data(spark):
    p = broken(lambda d: d["value_dictionaries"].append({"id": "v", "table": "customer", "column": "c_name", "values": [{"value": "Anna", "label": "Anna", "count": 1}], "status": "draft"}))
    p.cards["spaces"].append({"id": "space.x", "title": "ask a.b@example.org"})
    every = C.cards(spark, p)
    assert every.where(F.col("text").contains("Anna")).isEmpty()
    assert every.where("card_id = 'v'").head().text.endswith(C.BLOCKED)
    safe, unsafe = C.indexable(every)
    assert [r.card_id for r in unsafe.collect()] == ["space.x"] and safe.count() == every.count() - 1


def test_promotion_copies_and_checks(spark):
    p = demo.pack()
    one = lifecycle.Proposal(p.id, "metrics", p.cards["metrics"][1] | {"description": "confirmed"}, [{"source": "person"}])
    with pytest.raises(lifecycle.PromotionError):
        lifecycle.promote(spark, p, [one])
    new = lifecycle.promote(spark, p, [lifecycle.confirm(one, "Kim")])
    assert (p.version, new.version) == ("0.1.0", "0.1.1") and new.cards["metrics"][1]["status"] == "approved" and p.cards["metrics"][1]["status"] == "draft"
    bad = lifecycle.Proposal(p.id, "metrics", {"id": "metric.x", "required_tables": ["gone"]}, [{"source": "person"}])
    with pytest.raises(lifecycle.PromotionError):
        lifecycle.promote(spark, p, [lifecycle.confirm(bad, "Kim")])
    with pytest.raises(lifecycle.PromotionError):
        lifecycle.promote(spark, p, [lifecycle.confirm(lifecycle.Proposal(p.id, "metrics", {"id": "m"}, [{"is_test_only": True}]), "Kim")])


def test_planning():
    p = [demo.pack()]
    plan = planner.plan(p, demo.QUESTION, "analyst")
    assert plan.verified_query == "verified.monthly_net_revenue" and plan.confidence == 0.95 and plan.joins == ["join.orders_lineitem", "join.orders_customer"]
    assert planner.plan(p, demo.QUESTION, "nobody").tables == plan.tables  # no policy names the role: no restriction
    assert planner.plan(p, "weather").sql is None
    assert planner.understand(p, "휴면 고객 net revenue").unknown == ["휴면 고객"]
    assert planner.resolve_terms(p, ["first-time buyers", "x"]) == ({"first-time buyers": "term.new_customer"}, ["x"])


def test_profile_and_draft_keep_personal_values_out(spark):
    df = spark.createDataFrame([(1, "a@example.org", "paid", "1,200.5", "2026-1-3"), (2, "b@example.org", "open", "3", "2026/01/04"), (3, None, "paid", "n/a", "2026-01-05")], "order_id int, contact_mail string, status string, amount string, day string")
    rows = {r.column: r for r in profile.profile(df, "orders").collect()}
    assert rows["contact_mail"].is_pii and rows["contact_mail"].top_values is None and rows["contact_mail"].null_ratio == 0.3333
    assert rows["status"].top_values[0].value == "paid" and rows["status"].top_values[0]["count"] == 2
    assert (rows["amount"].type_guess, rows["amount"].numeric_max, rows["day"].type_guess, str(rows["day"].date_max)) == ("number", 1200.5, "date", "2026-01-05")
    assert rows["order_id"].join_key_candidate and not rows["amount"].join_key_candidate
    profiles = profile.profile(df, "orders")
    made = draft.draft_pack(profiles, "pack.x")
    assert packs.is_valid(spark, made) and made.cards["policies"][0]["blocked_columns"] == ["orders.contact_mail"]
    assert "example" not in str(made.to_dict())
    kinds = {r.kind for r in draft.hypotheses(profiles).collect()}
    assert {"table", "column", "metric", "policy"} <= kinds
    asked = {r.category for r in draft.questions(profiles).collect()}
    assert {"metric_definition", "join_relationship", "pii_policy"} <= asked


def test_questions_of_eight_categories(spark):
    df = spark.createDataFrame([(1, "a@example.org", "x", 5.0, "2026-01-03", "2026-01-04", None), (2, "b@example.org", "y", 6.0, "2026-01-03", "2026-01-05", None)], "order_id int, mail string, status string, amount double, paid_date string, sent_date string, note string")
    comments = spark.createDataFrame([("status", "code"), ("amount", "name of the payer"), ("note", "what the clerk wrote down")], "column string, comment string")
    profiles = profile.profile(df, "orders").join(comments, "column", "left")
    asked = draft.questions(profiles, draft.hypotheses(profile.profile(df, "orders")), ["orders", "bare"]).collect()
    found = {(r.category, r.target) for r in asked}
    assert {c for c, _ in found} == {"metric_definition", "join_relationship", "pii_policy", "missing_evidence", "ambiguous_date_basis", "comment_clarification", "comment_profile_conflict", "low_confidence"} and len({r.id for r in asked}) == len(asked)
    assert ("comment_clarification", "column.orders.status") in found and ("comment_profile_conflict", "column.orders.amount") in found and ("missing_evidence", "table.bare") in found
    assert ("missing_evidence", "column.orders.note") not in found and ("missing_evidence", "column.orders.status") in found
    assert ("low_confidence", "metric.orders.amount") in found
    assert {r.priority for r in asked if r.category in ("pii_policy", "ambiguous_date_basis", "comment_profile_conflict")} == {"high"}
    assert [r.target for r in draft.questions(profiles.limit(0)).collect()] == ["profiles"]


def test_join_candidates_are_ids(spark):
    columns = spark.createDataFrame([("a", "x_id"), ("b", "x_id"), ("c", "x_id"), ("a", "text"), ("b", "text"), ("a", "y_id")], "table string, column string")
    assert [tuple(r) for r in draft.join_candidates(columns).collect()] == [("x_id", "a", "b", 3)]


def test_results_are_compared_as_bags(spark):
    from tidemark.operators import compare

    df = lambda rows, schema="a int, b string": spark.createDataFrame(rows, schema)
    a = [(1, "x"), (1, "x"), (2, None), (None, "")]
    ask = lambda x, y: tuple(compare.results(x, y).head())
    assert ask(df(a), df(a[::-1], "c int, d string").repartition(3)) == (4, 4, 0, 0, True)
    assert ask(df(a), df(a[1:])) == (4, 3, 1, 0, False)
    assert ask(df(a), df([*a[:3], (None, None)])) == (4, 4, 1, 1, False)
    assert ask(df(a).limit(0), df(a).limit(0)) == (0, 0, 0, 0, True)
    assert ask(df(a), df(a).select("a")) == (4, 4, 4, 4, False)
    assert ask(df([(1.0000000001,)], "a double"), df([(1,)], "a int"))[4]
    with pytest.raises(PermissionError):
        compare.compare_results(spark, "DROP TABLE x", "SELECT 1", [], [])


def test_profile_of_an_empty_table(spark):
    (r,) = profile.profile(spark.createDataFrame([], "a string"), "t").collect()
    assert (r.column, r.row_count, r.null_count, r.null_ratio, r.cardinality, r.type_guess, r.top_values, r.join_key_candidate) == ("a", 0, 0, 0.0, 0, "unknown", None, False)


def test_pack_store_lists_loads_and_skips(spark, tmp_path):
    from tidemark.operators import store

    pack = demo.pack()
    path = store.put(str(tmp_path / "a" / "b"), pack)
    packs.save(pack, str(tmp_path / "z.json"))
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "odd.json").write_text('{"id": "odd", "nonsense": 1}')
    (tmp_path / "list.json").write_text("[1]")
    (tmp_path / "notes.txt").write_text("id: x")
    found = store.listing(str(tmp_path))
    assert [(e.path.rsplit("/", 1)[1], e.id) for e in found if e.id] == [(path.rsplit("/", 1)[1], pack.id), ("z.json", pack.id)]
    assert {e.path.rsplit("/", 1)[1] for e in found if e.error} == {"broken.json", "odd.json", "list.json"}
    assert store.by_id(str(tmp_path), pack.id).to_dict() == pack.to_dict() and len(store.all_packs(str(tmp_path))) == 1
    for missing in ("odd", "none"):
        with pytest.raises(packs.PackError):
            store.by_id(str(tmp_path), missing)
    with pytest.raises(packs.PackError):
        store.put(str(tmp_path / "a" / "b"), pack)
    assert store.frame(spark, str(tmp_path)).where("error is not null").count() == 3


def test_yaml_packs_keep_their_keys_in_order(tmp_path):
    pytest.importorskip("yaml")
    pack = demo.pack()
    packs.save(pack, str(tmp_path / "p.yaml"))
    again = packs.load(str(tmp_path / "p.yaml"))
    assert again.to_dict() == pack.to_dict() and list(again.to_dict()) == list(pack.to_dict())


def test_phone_shapes(spark):
    got = spark.createDataFrame([("+49 170 1234567",), ("2026-01-02",), ("US-2022-103800",), ("1234",)], "v string").select(pii.looks_like_phone(F.col("v")).alias("p")).collect()
    assert [r.p for r in got] == [True, False, False, False]


def test_evaluation(spark, sf):
    g = evaluate.golden(spark, [demo.pack()], [{"id": "a", "question": demo.QUESTION, "role": "analyst", "expected": ["metric.net_revenue"]}, {"id": "b", "question": "weather", "expected": ["metric.net_revenue"]}])
    assert [r.status for r in g.orderBy("case_id").collect()] == ["passed", "failed"]
    assert evaluate.summary(g).head().passed == 1


def test_closest_cards_stand_in_where_nothing_is_named():
    card = lambda i, term, definition: {"id": i, "term": term, "aliases": [], "definition": definition}
    doc = {"id": "p", "business_terms": [card(f"term.{k}", f"named{k}", "loyal buyers" if k < 6 else "others") for k in range(8)], "metrics": [{"id": "metric.m", "label": "label", "name": "n", "description": "loyal ones", "formula_sql": "1", "required_tables": []}]}
    p = packs.parse(doc)
    assert planner.closest_cards([p], "loyal") == [*(("business_term", f"term.{k}") for k in range(4))]
    assert planner.closest_cards([p], "loyal buyers", 9)[:6] == [*(("business_term", f"term.{k}") for k in range(6))] and planner.closest_cards([p], "loyal buyers", 9)[6] == ("metric", "metric.m")
    assert planner.closest_cards([p], "고객") == [] == planner.closest_cards([p], "") == planner.closest_cards([p], "loyal", 0)
    got = planner.plan([p], "which are loyal", fallback=True)
    assert got.terms == [f"term.{k}" for k in range(4)] and got.sql is None and "closest cards" in got.warnings[0]
    assert planner.plan([p], "which are loyal").terms == [] and planner.plan([p], "named7 loyal", fallback=True).terms == ["term.7"]
