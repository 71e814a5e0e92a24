"""Templates as columns against the same templates over plain values, and against texts written out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from leafmill.functions.template import compiled, parse
from leafmill.operators import cards, generation
from leafmill.plans import cards as plan
from leafmill.plans import templates
from leafmill.plans.config import Config

SCHEMA = "title string, section string, page int, flag boolean, tags array<string>, info struct<name string, n int>, half double"
ROWS = [("T", "S1", 3, True, ["a", "b", "c"], ("x", 1), 0.5), ("", "", 0, False, [], ("", 0), 0.0), (None, None, None, None, None, None, None), ("0", "<é>", -1, True, ["only"], (None, 7), 2.0)]

PROMPT = """You read "{{ title }}" (p. {{ page }}):

{% if section %}
**Section**: {{ section }}
{% endif %}
Make {{ max_cards | default(5) }} cards with {{c1::marks}} like {{c2::this}}.
{% if many %}
Many.
{% elif flag and page > 2 %}
Late.
{% else %}
Early.
{% endif %}
{% for t in tags %}
{{ loop.index }}. {{ t | upper }}{% if not loop.last %},{% endif %}

{% else %}
No tags.
{% endfor %}
"""

CASES = [
    PROMPT, "{{ title }}", "{{ section | default('N/A') }}", "{{ section | default('N/A', true) }}", "{{ title | upper | lower | trim }}", "{{ tags | join('; ') }}|", "{% set x = title %}{{ x }}{{ x }}",
    "{{ 'yes' if flag else 'no' }}", "{{ 'yes' if page in [3, 4] else 'no' }}", "{{ info.name }}-{{ info.n }}", "{% if info.n == 7 %}seven{% endif %}", "{% if tags %}some{% endif %}", "{% if half %}half{% endif %}",
    "{{ title or section or 'none' }}", "{% if section is defined and 'é' in section %}é{% endif %}", "{% if title is none %}null{% endif %}", "a {#- gone -#} b", "{%- if true -%}  x  {%- endif -%}", "  {% if true %}\nkept\n  {% endif %}\nend\n",
    "{{ title | replace('T', 'U') }}{{ title | length }}", "{% for t in tags %}{{ loop.first }}{{ t }}{% endfor %}", "{% for a in [1, 2] %}{% for t in tags %}{{ a }}{{ t }} {% endfor %}{% endfor %}", "{% if not (flag and page != 3) %}n{% endif %}", "{{ flag }}",
]


def plain(row):
    r = row.asDict(recursive=True)
    # what is null in a row is undefined in plain values
    return {k: v for k, v in r.items() if v is not None}


@pytest.mark.parametrize("source", CASES)
def test_columns_print_what_values_print(spark, source):
    df = spark.createDataFrame(ROWS, SCHEMA)
    made = compiled(parse(source), {c: F.col(c) for c in df.columns} | {"many": False})
    got = df.select("*", (F.lit(made) if isinstance(made, str) else made).alias("_out")).collect()
    for r in got:
        values = {c: r[c] for c in df.columns}
        values = {c: (v.asDict() if hasattr(v, "asDict") else v) for c, v in values.items()} | {"many": False}
        if values["tags"] is None and "tags" in source:
            continue  # a loop over nothing, tested below
        if values["page"] is None and (">" in source or "!=" in source):
            continue  # plain values can't be compared with nothing
        if values["info"] is None and "info" in source:
            continue
        assert r["_out"] == compiled(parse(source), values)


def test_written_out(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    columns = {c: F.col(c) for c in df.columns} | {"many": False}
    out = [r[0] for r in df.select(compiled(parse(PROMPT), columns)).collect()]
    assert out[0] == 'You read "T" (p. 3):\n\n**Section**: S1\nMake 5 cards with {{c1::marks}} like {{c2::this}}.\nLate.\n1. A,\n2. B,\n3. C\n'
    assert out[1] == 'You read "" (p. 0):\n\nMake 5 cards with {{c1::marks}} like {{c2::this}}.\nEarly.\nNo tags.\n'
    assert out[2] == 'You read "" (p. ):\n\nMake 5 cards with {{c1::marks}} like {{c2::this}}.\nEarly.\nNo tags.\n'
    j = [json.loads(r[0]) for r in df.select(compiled(parse('[{{ title | tojson }}, {{ page | tojson }}, {{ info | tojson }}, {{ tags | tojson }}]'), columns)).collect()]
    assert j[0] == ["T", 3, {"name": "x", "n": 1}, ["a", "b", "c"]] and j[2] == [None, None, None, None] and j[3][0] == "0"


@pytest.mark.parametrize("bad", ["{{ nobody }}", "{% if nobody %}x{% endif %}", "{% for x in nobody %}{% endfor %}", "{{ title | nofilter }}"])
def test_unknown_names_are_errors(bad):
    with pytest.raises(KeyError):
        compiled(parse(bad), {"title": "t"})


@pytest.mark.parametrize("bad", ["{% if x %}", "{% for x in y %}a", "{% macro a() %}", "{{ 1 + 2 }}", "{{ __import__('os') }}", "{{ title.upper() }}", "{% if x %}{% endfor %}"])
def test_what_is_no_template(bad):
    with pytest.raises((ValueError, SyntaxError)):
        compiled(parse(bad), {"title": "t", "x": 1, "y": []})


def test_prompt_files(spark, tmp_path):
    (tmp_path / "prompts/templates").mkdir(parents=True)
    (tmp_path / "prompts/templates/ext.j2").write_text("{% include 'head.j2' %} {{ chunk_text }} {{ safety_rule }}")
    (tmp_path / "prompts/templates/head.j2").write_text("Up to {{ max_cards | default(5) }}:\n")
    for n, file in (("a", "templates/ext.j2"), ("b", "prompts/templates/ext.j2"), ("c", "ext.j2"), ("d", "gone.j2")):
        (tmp_path / f"prompts/{n}.yaml").write_text(f"name: {n}\nversion: '1.0'\nsafety_rule: be safe\ntemplate_file: '{file}'\nparameters: {{max_cards: {{type: integer, default: 3}}}}\ntoken_limits: {{max_chunk_tokens: 2, truncation_strategy: middle}}\n")
    p = templates.prompts(str(tmp_path / "prompts"))
    d = spark.createDataFrame([("abcdefghijkl",)], "t string")
    for n in "abc":
        assert d.select(templates.render(p[n], chunk_text=F.col("t"))).first()[0] == "Up to 3: abcd...[middle truncated]...ijkl be safe"
    with pytest.raises(ValueError):
        templates.render(p["d"], chunk_text=F.col("t"))
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes/b.yaml").write_text("name: basic\nfields: {front: {description: q}, back: {description: a}}\nrendering: {csv_fields_order: [back, front]}\n")
    assert templates.note_types(str(tmp_path / "notes"))["basic"].csv_fields()[:3] == ["back", "front", "id"]


def test_a_run_asks_a_model_once_for_each_prompt(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1, "alpha text"), (2, 1, "beta text"), (3, 1, "beta text"), (4, 1, "fails")], "doc_id bigint, page_num int, raw_text string")
    paths = spark.createDataFrame([(i, "in/same.pdf") for i in (1, 2, 3, 4)], "doc_id bigint, source_pdf string")
    log = tmp_path / "log"
    log.mkdir()

    def model(system, prompt):
        (log / f"{abs(hash(prompt))}-{len(list(log.iterdir()))}").write_text(prompt)
        assert "question-and-answer" in system
        if "fails" in prompt:
            raise OSError
        return json.dumps({"cards": [{"front": f"What is {prompt[:9]}?", "back": "it"}]}), 10, 5

    config = Config.from_dict({"pipeline": {"deduplication": {"enabled": False}}, "generate": {"strategies": {"cloze_definitions": {"enabled": False}, "figure_based": {"enabled": False}}}})
    prompts = {"key_points": templates.Prompt("key_points", "{{ chunk }} of {{ pdf_title }}, {{ max_cards }}{% if section %}, {{ section }}{% endif %}")}
    ask = plan.Asking(model, prompts, "m", "p", str(tmp_path / "cache"), str(tmp_path / "usage"), retries=1, wait=lambda s: None)
    out = plan.build(pages, config, paths=paths, ask=ask, now=F.lit("now"))
    assert sorted(r["front"] for r in out.collect()) == ["What is alpha tex?", "What is beta text?", "What is beta text?"]
    asked = sorted(p.read_text() for p in log.iterdir())
    assert asked.count("alpha text of in/same.pdf, 5") == 1 and asked.count("beta text of in/same.pdf, 5") == 1 and asked.count("fails of in/same.pdf, 5") == 2
    plan.build(pages, config, paths=paths, ask=ask, now=F.lit("now")).count()
    assert len(list(log.iterdir())) == 4 + 2  # only the failed one is asked again
    u = generation.usage(spark.read.parquet(str(tmp_path / "usage"))).first()
    assert (u["total_tokens"], u["api_calls"], u["cache_hits"]) == (30, 7, 3)
    with pytest.raises(ValueError):
        plan.build(pages, config, paths=paths)
    with pytest.raises(ValueError):
        plan.build(pages, config, paths=paths, ask=plan.Asking(model, {}))


def test_a_second_run_knows_the_first(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1, "one line"), (2, 1, "another line")], "doc_id bigint, page_num int, raw_text string")
    config = Config.from_dict({"pipeline": {"deduplication": {"scope_persistent": True, "fuzzy_threshold": 1.0}}, "generate": {"strategies": {"cloze_definitions": {"enabled": False}, "figure_based": {"enabled": False}}}})
    run = lambda p, old, to: plan.build(p, config, index=old, ask=cards.mock_responses, now=F.lit("now"), new_index=str(tmp_path / to)).count()
    none = spark.createDataFrame([], "content_hash string")
    assert run(pages, none, "i1") == 2
    assert run(pages.unionByName(spark.createDataFrame([(3, 1, "third line")], pages.schema)), spark.read.json(str(tmp_path / "i1")), "i2") == 1
    assert spark.read.json(str(tmp_path / "i2")).count() == 3
