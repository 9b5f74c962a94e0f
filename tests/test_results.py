"""Nested results: assembled, counted, loaded; round trips and edges."""

import json
import random

from pyspark.sql import functions as F

from docloom.operators import iterate, results, trees

NODES = "tree_id long, node_id string, parent_node_id string, answer string, sibling_ord int, node_type string, question_text string, question_type string, options array<string>, outcome_type string, confidence_score double"


def random_tree(tree, rng, size):
    rows, open_nodes = [], []
    for i in range(size):
        up = open_nodes.pop(0) if open_nodes else None
        asks = i < size // 3 or not open_nodes and i < size - 1
        kind = rng.choice(["yes_no", "multiple_choice", "date"])
        name = f'n{i} "{rng.choice("äß中")}"'
        rows.append((tree, name, up and up[0], up and up[1], up[2] if up else 0, "question" if asks else "outcome", f"Why {i}?\n" if asks else None, kind if asks else None, ["a", 'b"'] if asks and kind == "multiple_choice" else None, None if asks else rng.choice(["approved", "denied"]), rng.randint(0, 100) / 100))
        if asks:
            open_nodes += [(name, answer, nth) for nth, answer in enumerate(rng.sample(["yes", "no", 'may"be', "{x}"], rng.randint(1, 3)))]
    return rows


def test_parsing_what_was_assembled_is_the_identity(spark):
    rng = random.Random(7)
    rows = [r for tree in range(4) for r in random_tree(tree, rng, rng.randint(1, 40))]
    known = {(r[0], r[1]) for r in rows}
    assert len(known) == len(rows)
    nodes = spark.createDataFrame(rng.sample(rows, len(rows)), NODES)
    nested = results.tree_json(nodes)
    assert all(json.loads(r.json)["node_id"] for r in nested.collect())
    back = trees.parse_nodes(nested)
    assert sorted(map(repr, back.select(*nodes.columns).collect())) == sorted(map(repr, nodes.collect()))
    again = results.tree_json(back)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, nested.collect()))


def test_lists_keep_their_order_and_cycles_are_left_out(spark):
    rows = [(1, i, f"p{i}", f"p{(i - 1) // 2}" if i else None, f"t{i}", 0.5) for i in range(12)] + [(2, 0, "a", "b", "x", 0.1), (2, 1, "b", "a", "y", 0.1), (3, 5, "z", "gone", None, None)]
    policies = spark.createDataFrame(rows, "job_id long, ord int, policy_id string, parent_id string, title string, confidence double")
    definitions = spark.createDataFrame([(1, "term", 'is "it"')], "job_id long, term string, definition string")
    found = {r.job_id: json.loads(r.json) for r in results.hierarchy_json(policies, definitions).collect()}

    def ids(node):
        return [node["policy_id"], *[ids(k) for k in node.get("children", [])]]

    assert ids(found[1]["root_policies"][0]) == ["p0", ["p1", ["p3", ["p7"], ["p8"]], ["p4", ["p9"], ["p10"]]], ["p2", ["p5", ["p11"]], ["p6"]]]
    assert found[1]["definitions"] == {"term": 'is "it"'} and found[1]["max_depth"] == 3 and found[1]["total_policies"] == 12
    assert found[2]["root_policies"] == [] and found[3]["root_policies"] == [{"policy_id": "z"}]


def test_results_are_saved_and_loaded(spark):
    validation = {"overall_confidence": 0.5, "is_valid": True, "issues": [{"severity": "info"}, {"severity": "error"}, {}]}
    raw = [(1, json.dumps({"metadata": {"total_pages": 3, "kept": [1, {"x": None}]}, "decision_trees": [{"a": 1}], "validation_result": validation, "policy_hierarchy": {"total_policies": 2, "root_policies": [{}], "definitions": {"a": "b"}}})), (2, "{}"), (3, "broken"), (9, "{}")]
    stored = spark.createDataFrame(raw, "job_id long, result_json string")
    jobs = spark.createDataFrame([(1, 7, 1.5, None, "old"), (2, None, None, 0.9, None), (3, None, None, None, None), (4, 8, None, 0.2, None)], "job_id long, total_pages int, processing_time_seconds double, validation_confidence double, document_type string")
    rows, updated, history = results.save_results(stored, jobs)
    got = {r.job_id: r for r in rows.collect()}
    assert set(got) == {1, 2, 3} and (got[1].total_issues, got[1].error_count, got[1].info_count, got[1].warning_count, got[1].total_root_policies, got[1].is_valid) == (3, 1, 1, 0, 1, True)
    assert (got[2].total_policies, got[2].is_valid, got[2].overall_confidence) == (0, False, 0.0) == (got[3].total_policies, got[3].is_valid, got[3].overall_confidence)
    after = {r.job_id: r for r in updated.collect()}
    assert (after[1].total_pages, after[1].validation_confidence, after[4].total_pages, after[4].validation_confidence) == (3, 0.5, 8, 0.2) and history.count() == 3

    documents = spark.createDataFrame([(1, None, "aGk="), (2, "b.pdf", "%%")], "job_id long, filename string, content_base64 string")
    loaded = {r.job_id: r for r in results.load_job_results(stored, documents, jobs).collect()}
    first = json.loads(loaded[1].result_json)
    assert bytes(loaded[1].document_content) == b"hi" and loaded[1].document_filename == "document.pdf"
    assert first["metadata"]["kept"] == [1, {"x": None}] and first["metadata"]["document_type"] == "old" and first["metadata"]["total_pages"] == 7 and "validation_confidence" not in first["metadata"]
    assert first["validation_result"]["overall_confidence"] == 0 and first["validation_result"]["is_valid"] and len(first["validation_result"]["issues"]) == 3
    assert loaded[2].document_content is None and loaded[2].document_error == "not base64"
    assert json.loads(loaded[2].result_json)["validation_result"] == {"overall_confidence": 0.9}
    assert json.loads(loaded[9].result_json)["metadata"] == {} and loaded[9].document_filename is None


def test_nested_text_is_never_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([("t", f"n{i}", f"n{i // 2}" if i > 1 else None, i) for i in range(1, 16)], "g string, id string, up string, o long")
    plans = []
    for module in (results, iterate):
        monkeypatch.setattr(module, "cut", lambda df, of=iterate.cut: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or of(df))
    got = results.nested_json(rows, "g", "id", "up", "o", F.to_json(F.struct("id"))).collect()
    assert [r.id for r in got] == ["n1"] and got[0].json.count('"id"') == 15
    assert plans and not any("BroadcastHashJoin" in p for p in plans)
