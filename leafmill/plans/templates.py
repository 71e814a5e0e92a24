"""Note types and prompts: YAML files on the driver, rendered as column expressions."""

from __future__ import annotations

import glob
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions import template
from leafmill.functions.text import truncate_tokens

#: What every card table has besides its note type's own fields.
PROVENANCE = (
    "id", "note_type", "deck", "tags", "media", "source_pdf", "page_start", "page_end", "section", "ref_citation", "llm_model", "llm_version", "strategy",
    "template_version", "created_at", "updated_at", "core_concept", "longtext", "original_text", "my_notes",
)
SYSTEM_PROMPTS = {
    "key_points": "You write question-and-answer cards from a text. Use only what the text says and cite its page.",
    "cloze_definitions": "You write cloze cards for definitions in a text. Mark one to three gaps and cite the page.",
    "figure_based": "You write cards about figures and tables that a text describes. Cite the page.",
}


def system_prompt(strategy: str) -> str:
    return SYSTEM_PROMPTS.get(strategy, SYSTEM_PROMPTS["key_points"])


@dataclass
class NoteType:
    name: str
    fields: list[str] = field(default_factory=list)
    csv_fields_order: list[str] = field(default_factory=list)
    version: str = "1.0"

    def csv_fields(self) -> list[str]:
        """Own fields first, then the provenance."""
        own = self.csv_fields_order or self.fields
        return [*own, *[p for p in PROVENANCE if p not in own]]


@dataclass
class Prompt:
    name: str
    template: str
    version: str = "1.0"
    note_type: str = ""
    safety_rule: str = ""
    parameters: dict = field(default_factory=dict)
    max_chunk_tokens: int | None = None
    truncation_strategy: str = "end"
    folder: str = ""


def _files(folder: str) -> list[dict]:
    import yaml

    out = []
    for path in sorted(glob.glob(os.path.join(folder, "*.yaml"))):
        try:
            with open(path, encoding="utf-8") as f:
                data = yaml.safe_load(f)
            if isinstance(data, dict) and data.get("name"):
                out.append(data)
        except (OSError, yaml.YAMLError):
            continue  # a bad file leaves the others usable
    return out


def note_types(folder: str) -> dict[str, NoteType]:
    """By name. Fields are a list or a mapping; the order of the columns stands at the top or under ``rendering``."""
    def names(fields) -> list[str]:
        return [f["name"] if isinstance(f, dict) else f for f in fields or []]  # of a mapping these are its keys

    out = {}
    for d in _files(folder):
        order = (d.get("rendering") or {}).get("csv_fields_order") or d.get("csv_fields_order") or []
        out[d["name"]] = NoteType(d["name"], names(d.get("fields")), list(order), str(d.get("version", "1.0")))
    return out


def _version(x: str) -> tuple:
    return tuple(int(p) for p in re.findall(r"\d+", x))


def _found(folder: str, name: str) -> str | None:
    """A template file under the folder, its ``templates`` folder, or named from the folder above."""
    for place in (folder, os.path.join(folder, "templates"), os.path.dirname(os.path.abspath(folder))):
        if os.path.isfile(path := os.path.join(place, name)):
            return path
    return None


def _read(folder: str, name: str) -> str:
    path = _found(folder, name)
    if path is None:
        raise FileNotFoundError(f"no template file {name!r} in {folder!r}")
    with open(path, encoding="utf-8") as f:
        return f.read()


def prompts(folder: str) -> dict[str, Prompt]:
    """By name; of two files with one name the higher version counts. A template stands in the file or in the one that
    ``template_file`` names; a prompt with neither can't be rendered."""
    out: dict[str, Prompt] = {}
    for d in _files(folder):
        defaults = {k: (x.get("default") if isinstance(x, dict) else x) for k, x in (d.get("parameters") or {}).items()}
        limits = {**d, **(d.get("token_limits") or {})}
        template, file = d.get("template") or "", d.get("template_file")
        if not template and file and _found(folder, file):
            template = _read(folder, file)
        p = Prompt(d["name"], template, str(d.get("version", "1.0")), d.get("note_type", ""), d.get("safety_rule", ""), defaults, limits.get("max_chunk_tokens"), limits.get("truncation_strategy", "end"), folder)
        if p.name not in out or _version(p.version) >= _version(out[p.name].version):
            out[p.name] = p
    return out


def template_files(folder: str) -> list[str]:
    """Names of the template files (``*.j2``) of a folder, in order; none where there is no such folder."""
    return sorted(os.path.basename(p) for p in glob.glob(os.path.join(folder, "*.j2")))


def template_file(folder: str, name: str) -> Prompt:
    """A template file as a prompt; an unknown name is an error."""
    return Prompt(os.path.splitext(os.path.basename(name))[0], _read(folder, name), folder=folder)


def render(prompt: Prompt, **context: object) -> Column:
    """The prompt as a column. Values are columns or Python values; the prompt's own parameters and its safety rule are
    known too. A text over ``max_chunk_tokens`` is cut first. A name that nothing gives, or a prompt without a template, is
    an error. The language is that of ``leafmill.functions.template``."""
    if not prompt.template:
        raise ValueError(f"prompt {prompt.name!r} has no template")
    values: dict[str, object] = {**prompt.parameters, **context, "safety_rule": prompt.safety_rule}
    for name in ("chunk_text", "chunk"):
        if prompt.max_chunk_tokens and isinstance(values.get(name), Column):
            values[name] = truncate_tokens(values[name], prompt.max_chunk_tokens, prompt.truncation_strategy)
    try:
        out = template.compiled(template.parse(prompt.template), values, lambda name: _read(prompt.folder, name))
    except KeyError as e:
        raise KeyError(f"prompt {prompt.name!r} needs {e.args[0]!r}") from e
    return out if isinstance(out, Column) else F.lit(out)
