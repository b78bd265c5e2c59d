"""Nesting of elements, their faults, and nested control flow, by case."""

import random

import pytest

from loomspark.operators import elements


def corpus_of(spark, *texts):
    return spark.createDataFrame([(f"f{k}.html", t) for k, t in enumerate(texts)], "path string, content string")


CASES = {
    '<li ng-repeat="item in items">{{ a < b }}</li>': "@for (item of items; track item) {\n<li>{{ a < b }}</li>\n}",
    '<div ng-repeat="block in blocks"><div ng-repeat="col in block.cols">{{col.name}}</div></div>': "@for (block of blocks; track block) {\n<div>@for (col of block.cols; track col) {\n<div>{{col.name}}</div>\n}</div>\n}",
    '<li ng-repeat="x in y" ng-if="z">content</li>': "@for (x of y; track x) {\n@if (z) {\n<li>content</li>\n}\n}",
    '<li ng-repeat="a in as">1</li><li ng-if="b">2</li>': "@for (a of as; track a) {\n<li>1</li>\n}@if (b) {\n<li>2</li>\n}",
    "<li ng-if=\"vm.check('foo::bar') && ::x\">x</li>": "@if (vm.check('foo::bar') && x) {\n<li>x</li>\n}",
    '<img ng-repeat="img in $ctrl.phone.images" />': "@for (img of $ctrl.phone.images; track img) {\n<img />\n}",
    '<p class="a" ng-show="::b" id="c"><b>t</b></p>': '<p class="a" [hidden]="!(b)" id="c"><b>t</b></p>',
    '<p ng-if="a" ng-show="b" ng-repeat="c in d track by c.id" x>t</p>': '@for (c of d; track c.id) {\n@if (a) {\n<p [hidden]="!(b)" x>t</p>\n}\n}',
    "<UL\n  ng-if='a > 1'\n  CLASS=x>\n<li>1</li></ul>": "@if (a > 1) {\n<UL\n  CLASS=x>\n<li>1</li></ul>\n}",
    '<!-- <p ng-if="no"> --><script>if (a < b) "<p ng-if=no>"</script><p ng-if="y"></p>': '<!-- <p ng-if="no"> --><script>if (a < b) "<p ng-if=no>"</script>@if (y) {\n<p></p>\n}',
    '<p ng-repeat="a in b | f" ng-if="c">t</p>': '@if (c) {\n<p ng-repeat="a in b | f">t</p>\n}',
    '<div><br><p ng-if="é𝔘">é</p><input ng-if="q"></div>': '<div><br>@if (é𝔘) {\n<p>é</p>\n}@if (q) {\n<input>\n}</div>',
    '<p ng-if="a" ng-if="b">x</p>': None, "<p>none</p>": None, '<p ng-if="a"><b></p></b>': None, '<p ng-if="">x</p>': None, "": None,
}


def test_blocks_go_around_whole_elements(spark):
    got = {r.path: (r.output, r.reason is None) for r in elements.control_flow(corpus_of(spark, *CASES, None)).collect()}
    assert got == {f"f{k}.html": (want, want is not None) for k, want in enumerate(CASES.values())}


def test_reasons_of_single_attributes(spark):
    texts = {
        '<p ng-repeat="a in b | f">': [f'ng-repeat="a in b | f": {elements.PIPE}'], '<p ng-repeat="(k, v) in m">': [f'ng-repeat="(k, v) in m": {elements.PAIRS}'], '<p ng-repeat="a in b as c">': [f'ng-repeat="a in b as c": {elements.ALIAS}'],
        "<p ng-repeat>": ["ng-repeat: " + elements.NO_VALUE], '<p ng-repeat="abc">': [f'ng-repeat="abc": {elements.GRAMMAR}'], '<p ng-repeat="a.b in c" ng-if=" ">': ['ng-repeat="a.b in c": loop variable "a.b" is not a simple identifier — not safely transformable', "ng-if: " + elements.NO_VALUE],
        '<p ng-if="fine">': [],
    }
    got = {r.path: r.told for r in elements.planned(corpus_of(spark, *[t + "</p>" for t in texts])).collect()}
    assert got == {f"f{k}.html": want for k, want in enumerate(texts.values())}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<p><b></p></b>", [(0, "end-tag-mismatch"), (3, "end-tag-mismatch")]), ("<p><br><li>", [(0, "unclosed-element"), (7, "unclosed-element")]), ("</p>\n<p></p></P>", [(0, "stray-end-tag"), (12, "stray-end-tag")]),
        ('<div class="x>broken</div>', [(0, "unfinished-tag"), (20, "stray-end-tag")]), ("a < b <c></c> 1<2", []), ('<p a="1" A=2 b></p><br c c>', [(0, "duplicate-attribute"), (19, "duplicate-attribute")]), ("{{ a <b }}<!-- <p> -->", []),
    ],
)
def test_faults_have_a_code_and_a_place(spark, text, want):
    got = sorted((r.start, r.code) for r in elements.faults(corpus_of(spark, text)).collect())
    assert got == sorted(want)


def test_nesting_against_a_stack(spark):
    rng, texts, want = random.Random(6), [], {}
    for k in range(40):
        out, stack, found = [], [], {}
        at = lambda: sum(map(len, out))  # noqa: B023, E731
        for _ in range(rng.randint(0, 25)):
            what = rng.random()
            if what < 0.4:
                tag = rng.choice(["div", "ul", "li", "p-x"])
                found[at()] = [tag, len(stack), None]
                stack.append((tag, at()))
                out.append(f"<{tag} a='>' b=\"</{tag}>\">")
            elif what < 0.7 and stack:
                tag, start = stack.pop()
                found[start][2] = at()
                out.append(f"</{tag}>")
            else:
                out.append(rng.choice(["text é", "<!-- </div> -->", "{{ a </div> }}"]))
        while stack:
            tag, start = stack.pop()
            found[start][2] = at()
            out.append(f"</{tag}>")
        texts.append("".join(out))
        want[f"f{k}.html"] = {s: tuple(v) for s, v in found.items()}
    got = {p: {} for p in want}
    for r in elements.elements(corpus_of(spark, *texts)).collect():
        assert r.fault is None
        got[r.path][r.start] = (r.tag, r.depth, r.end_start)
    assert got == want


def test_control_flow_nests_elements_once(spark, monkeypatch):
    asked, plain = [], elements.elements
    monkeypatch.setattr(elements, "elements", lambda corpus: asked.append(1) or plain(corpus))
    df = spark.createDataFrame([("a.html", '<p ng-if="a">x</p>'), ("b.html", '<p ng-if="a" ng-if="b">x</p>')], "path string, content string")
    got = {r.path: (r.matched, r.output) for r in elements.control_flow(df).collect()}
    assert got == {"a.html": (True, "@if (a) {\n<p>x</p>\n}"), "b.html": (False, None)} and len(asked) == 1
