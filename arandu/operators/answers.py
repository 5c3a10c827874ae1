"""Grounding, prompt and citations of an answer; the model is a function that the caller gives."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled

GROUNDING = 6
INSTRUCTIONS = "Responda somente com base nos trechos numerados. Não invente fatos. Se os trechos não bastarem, diga o que falta. Cite as fontes no formato [n] ao lado de cada afirmação."


def reference(file_name: Column, path: Column, place: Column, number: Column) -> Column:
    """File, heading path and place; the chunk's number if all are missing."""
    return F.coalesce(filled(F.concat_ws(" | ", filled(F.trim(file_name)), filled(F.trim(path)), filled(F.trim(place)))), F.concat(F.lit("chunk_"), number.cast("string")))


def grounding(results: DataFrame, order: Sequence[Column], most: int = GROUNDING) -> DataFrame:
    """The first results (id from 1) with their references; results are few, as a search limits them."""
    first = results.orderBy(*order).limit(max(most, 1))
    ranked = first.withColumn("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    place = F.coalesce(*(filled(c) for c in ("locator_path", "position_text", "chunk_id") if c in results.columns))
    return ranked.withColumn("reference", reference(F.col("file_name"), F.col("heading_path_text"), place, F.col("id")))


def cited(answers: DataFrame, answer: str = "answer_text", items: str = "grounding") -> DataFrame:
    """answers (text, grounding array of struct(id, reference)) with citations: those cited as [n], in order, else all."""
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(F.col(answer), F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda n: n.cast("int")))
    chosen = F.filter(F.transform(numbers, lambda n: F.get(F.filter(F.col(items), lambda g: g["id"] == n), F.lit(0))), lambda g: g.isNotNull())
    return answers.withColumn("citations", F.when(F.size(chosen) > 0, chosen).otherwise(F.col(items)))


def prompt(query: str, filters: Mapping[str, Any], mode: str, profile: str, items: Sequence[Mapping[str, Any]]) -> str:
    """Question, filters and numbered passages."""
    chosen = ", ".join(f"{k}={v}" for k, v in filters.items()) or "sem filtros"
    lines = [f"Pergunta: {query}", f"Filtros: {chosen}", f"Modo de busca: {mode}", f"Perfil: {profile}", "", "Trechos:"]
    for g in items:
        lines += [f"[{g['id']}] {g['reference']}", f"tipo={g.get('archetype') or 'unknown'} | score={g.get('score') or 0} | modo={g.get('retrieval_mode') or 'textual'}", g.get("text") or "", ""]
    return "\n".join([*lines, "Responda em português, de forma objetiva, com citações [n]."])


def citations(text: str, items: Sequence[Mapping[str, Any]]) -> list[dict[str, Any]]:
    """cited() of one answer."""
    known = {int(g["id"]): {"id": g["id"], "reference": g["reference"]} for g in items}
    found = [known[n] for n in dict.fromkeys(int(x) for x in re.findall(r"\[(\d+)\]", text)) if n in known]
    return found or list(known.values())


def service_url(endpoint: str | None) -> str:
    """Base address of a model service from any of the forms in which it is given."""
    own = str(endpoint or "").strip().rstrip("/")
    if not own:
        return ""
    for ending, missing in (("/openai/v1", "/"), ("/openai", "/v1/")):
        if own.endswith(ending):
            return own + missing
    return own + "/openai/v1/"


def service_model(endpoint: str, key: str, name: str, timeout: float = 60.0, opener: Callable[..., Any] | None = None) -> Callable[[str, str], str]:
    """A model behind an HTTP service that takes chat messages and gives choices; opener is urllib's, or one for tests."""
    import json
    import urllib.request

    def ask(instructions: str, text: str) -> str:
        body = {"model": name, "messages": [{"role": "system", "content": instructions}, {"role": "user", "content": text}]}
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {key}", "api-key": key}
        request = urllib.request.Request(service_url(endpoint) + "chat/completions", json.dumps(body).encode(), headers)
        with (opener or urllib.request.urlopen)(request, timeout=timeout) as got:
            return json.load(got)["choices"][0]["message"]["content"]

    return ask


@dataclass
class Answer:
    status: str
    query: str
    text: str = ""
    citations: list[dict[str, Any]] = field(default_factory=list)
    grounding: list[dict[str, Any]] = field(default_factory=list)
    error: str | None = None

    def markdown(self) -> str:
        sources = ["", "## Fontes usadas", "", *(f"- [{c['id']}] {c['reference']}" for c in self.citations)] if self.citations else []
        return "\n".join([self.text.strip(), *sources]).strip()


Model = Callable[[str, str], str]


def answer(query: str, items: Sequence[Mapping[str, Any]], model: Model | None, filters: Mapping[str, Any] | None = None, mode: str = "textual", profile: str = "legal", missing: Sequence[str] = ()) -> Answer:
    """no_context without passages, config_error without a model, provider_error if it fails, else ok."""
    own = [dict(g) for g in items]
    if not own:
        return Answer("no_context", query, "Nenhum trecho encontrado para a pergunta.")
    if model is None or missing:
        return Answer("config_error", query, grounding=own, error="missing: " + (", ".join(missing) or "model"))
    try:
        text = model(INSTRUCTIONS, prompt(query, filters or {}, mode, profile, own))
    except Exception as e:  # noqa: BLE001  the service's fault is the answer's status
        return Answer("provider_error", query, grounding=own, error=f"{type(e).__name__}: {e}")
    return Answer("ok", query, text, citations(text, own), own)
