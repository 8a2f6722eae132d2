"""Queries over orders read their pages once: work and the driver's share grow with the orders only."""

import pytest

from sylvan.cases import QUERIES
from sylvan.css.parser import parse
from sylvan.markup import forms
from sylvan.markup.treebuilder import parse_document
from sylvan.operators.frame import carried_out, stage
from sylvan.queries import EDITS

SF = "/root/testdata/sf0.001"
READS = ["ancestors", "ancestors_k", "children", "descendants", "sel_li_nth_last", "sel_attr_substring", "sel_attr_exists"]
EDITED = [f"edit_{n}" for n in ("append_html", "before_html", "normalize", "prepend_html", "remove_children", "replace_with_html", "replace_with_nothing", "set_html", "set_text", "strip", "unwrap")]


@pytest.mark.parametrize("name", READS + EDITED)
def test_pages_are_made_and_parsed_once(spark, name):
    """Plans over the node table made and parsed the pages once for each of their parts, and joined those by broadcasts from the driver where sizes looked small."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("FileScan") == 2 and plan.count("Exchange") == 2
    assert "Broadcast" not in plan and "Window" not in plan


@pytest.mark.parametrize("name", [n for n in EDITED if n != "edit_normalize"])
def test_alike_pages_are_edited_once(monkeypatch, name):
    """Each page was parsed and edited by itself."""
    selector, verb, args, _ = EDITS[name.removeprefix("edit_")]
    steps = ((((("select", parse(selector))),), verb, args, None),)
    parsed, stages = [], [stage(*s) for s in steps]
    monkeypatch.setattr(forms, "parse_document", lambda html: parsed.append(html) or parse_document(html))
    own = forms.Forms(False, lambda doc: carried_out(doc, steps), stages)
    for i in range(600):
        items = "".join(f'<li class="item {"RAN"[(i + k) % 3]} O" data-part="{i}">part {i}</li>' for k in range(i % 3))
        html = f'<div class="order O" id="o{i}" data-prio="1"><ul>{items}</ul></div>'
        one, two = own.read(html), parse_document(html)
        carried_out(two, steps)
        assert forms.to_html(one.root) == forms.to_html(two.root)
    assert len(parsed) == 6  # of three forms: the first page, and the form
