import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators.nested import Invalid, json_triples, tree_lists, tree_nodes, triples


def nodes_of(text):
    return [(t[1], t[2]) for t in triples(text) if t[0] == "nodes" and t[5] == "object"]


def test_positions_count_every_element():
    assert nodes_of('{"structure": [{"nodes": ["x", null, {"title": "a"}]}, 3, {}]}') == [("0", ""), ("0.2", "0"), ("2", "")]


def test_single_object_in_place_of_a_list():
    assert nodes_of('{"hierarchy": {"nodes": {"title": "a"}}}') == [("0", ""), ("0.0", "0")]


def test_file_itself_is_the_list_or_a_node():
    assert nodes_of('[{"nodes": [{}]}]') == [("0", ""), ("0.0", "0")]
    assert nodes_of('{"title": "x", "nodes": [{}]}') == [("0", ""), ("0.0", "0")]


def test_structure_before_hierarchy_unless_it_is_no_list():
    assert nodes_of('{"hierarchy": [{}], "structure": [{}, {}]}') == [("0", ""), ("1", "")]
    assert nodes_of('{"structure": null, "hierarchy": [{}]}') == [("0", "")]


def test_last_of_repeated_keys_counts():
    assert nodes_of('[{"nodes": [{}, {}], "nodes": [{}]}]') == [("0", ""), ("0.0", "0")]


@pytest.mark.parametrize("bad", ["", "[1,]", '{"a":1,}', "01", "[1 2]", "NaN", '"a', '{"a" 1}', "[]x", "nul", "{1:2}", "[}", "{]", '"\x01"', "﻿[]", "[1]]"])
def test_invalid(bad):
    with pytest.raises(Invalid):
        triples(bad)


def test_depth_is_no_limit():
    n = 5000
    assert len(nodes_of("[" + '{"nodes":[' * n + "]}" * n + "]")) == n


values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.sampled_from(["nodes", "structure", "hierarchy", "title", "a"]), x, max_size=4), max_leaves=20)


def walk(items, base):
    out = []
    for i, v in enumerate(items if isinstance(items, list) else [items] if isinstance(items, dict) else []):
        if isinstance(v, dict):
            p = f"{base}.{i}" if base else str(i)
            out.append((p, base))
            out += walk(v.get("nodes"), p)
    return out


@given(values)
def test_against_a_plain_walk(v):
    top = v
    if isinstance(v, dict):
        top = next((v[k] for k in ("structure", "hierarchy") if isinstance(v.get(k), (list, dict))), v)
    import re

    got = [x for x in nodes_of(json.dumps(v)) if re.fullmatch(r"\d+(\.\d+)*", x[0])]
    assert sorted(got) == sorted(walk(top, "") if isinstance(top, (list, dict)) else [])


@given(st.text(alphabet='[]{}",:0123456789.eE+-truefalsn\\ u"', max_size=30))
def test_accepts_what_the_library_accepts(s):
    try:
        json.loads(s, parse_constant=lambda _: 1 / 0)
        ok = True
    except (ValueError, ZeroDivisionError):
        ok = False
    try:
        triples(s)
        mine = True
    except Invalid:
        mine = False
    assert mine == ok


def test_tables(spark):
    rows = [("a", '{"structure": [{"title": "t", "start_index": "3", "end_index": 4.0, "blocks": [{"type": "x", "page": 3, "refs": {"id": "r"}}]}]}', 1), ("a", None, 2), ("b", "{", 3), (None, "[{}]", 4)]
    t = json_triples(spark.createDataFrame(rows, "doc_id string, raw_json string, address int"))
    got = {(r.doc_id, r.node_path, r.title, r.start_index, r.end_index) for r in tree_nodes(t).collect()}
    assert got == {("a", "0", "t", 3, 4), (None, "0", None, None, None)}
    blocks = tree_lists(t, "blocks", {"type": "string", "page": "int"}).collect()
    assert [(b.item_path, b.parent_path, b.type, b.page) for b in blocks] == [("0/blocks.0", "0", "x", 3)]
    refs = tree_lists(t, "refs", {"id": "string"}).collect()
    assert [(b.parent_path, b.id) for b in refs] == [("0/blocks.0", "r")]


def test_empty_table(spark):
    t = json_triples(spark.createDataFrame([], "doc_id string, raw_json string"))
    assert tree_nodes(t).count() == 0 and t.where(F.lit(True)).count() == 0
