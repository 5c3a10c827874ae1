"""Document archetypes, domains and batch folders as rules over columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import fold, slug


def hits(text: Column, hints: list[str]) -> Column:
    """How many of the hints the text contains."""
    return reduce(lambda a, b: a + b, [text.contains(h).cast("int") for h in hints])


def search_text(names: list[Column], titles_and_texts: Column, limit: int) -> Column:
    """Folded file names, mode and root tag, then titles and texts of the first blocks, one on each line; blank ones left out."""
    parts = F.concat(F.array(*(fold(c) for c in names)), F.flatten(F.transform(F.slice(titles_and_texts, 1, limit), lambda b: F.array(fold(b["title"]), fold(b["text"])))))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n")


def _count(kinds: Column, wanted: list[str]) -> Column:
    return F.size(F.filter(kinds, lambda k: k.isin(wanted)))


def archetypes(documents: DataFrame) -> DataFrame:
    """documents (file_name, file_stem, file_type, source_path, mode, root_tag, transaction_count, blocks) with archetype.

    Rules in order: OFX, legal (amending or normative), manual, spreadsheet, XML, judicial, generic.
    """
    names = [F.col(c) for c in ("file_name", "file_stem", "source_path", "file_type", "mode", "root_tag")]
    head = F.transform(F.slice("blocks", 1, 14), lambda b: F.struct(b["title"].alias("title"), b["text"].alias("text")))
    rows = documents.withColumns({"_kinds": F.transform("blocks", lambda b: b["kind"]), "_text5": search_text(names, head, 5), "_text12": search_text(names, head, 12), "_text14": search_text(names, head, 14), "_file": F.concat_ws(" ", F.nullif(fold("file_name"), F.lit("")), F.nullif(fold("file_stem"), F.lit(""))), "_mode": fold("mode"), "_root": fold("root_tag"), "_type": fold("file_type")})
    kinds, mode = F.col("_kinds"), F.col("_mode")
    some = lambda wanted: F.arrays_overlap(F.coalesce(kinds, F.array().cast("array<string>")), F.array(*map(F.lit, wanted)))
    some_ = lambda wanted: F.coalesce(some(wanted), F.lit(False))
    file = F.col("_file")
    headings, articles = _count(kinds, V.HEADING_KINDS), _count(kinds, ["article"])
    add = lambda test, n=1: test.cast("int") * n
    normative = (
        add(F.col("mode").eqNullSafe("structured_legal"))
        + add(_count(kinds, ["preamble"]) > 0)
        + add(headings >= 2, 3)
        + add(headings >= 4, 2)
        + add(articles >= 3)
        + add(articles >= 8)
        + add(headings + articles >= 6)
        + add(file.contains("lei complementar") | file.contains("lei ordinaria") | file.contains("codigo"))
    )
    amending = hits(F.col("_text12"), V.AMENDING_HINTS) + 2 * hits(F.col("_text5"), V.CORE_AMENDING_HINTS) + add(file.contains("emenda constitucional"), 3) + add(file.contains("altera") | file.contains("alteracoes"))
    for n in (2, 4):
        amending = F.greatest(amending - add(headings >= n), F.lit(0))
    legal_type = F.when(amending >= F.greatest(F.lit(3), normative + 1), V.ARCHETYPES[1]).otherwise(V.ARCHETYPES[0])
    manual_hits, operational = hits(F.col("_text14"), V.MANUAL_HINTS), hits(F.col("_text14"), V.OPERATIONAL_HINTS)
    is_manual = mode.isin("structured_manual", "structured_faq") | (manual_hits >= 2) | ((manual_hits >= 1) & (operational >= 2)) | ((_count(kinds, ["heading"]) >= 2) & (operational >= 3) & ~some_(["page_text"]))
    kind = (
        F.when((F.col("_type") == "ofx") | (F.col("_root") == "ofx") | some_(["transaction"]) | F.col("transaction_count").isNotNull(), V.ARCHETYPES[6])
        .when((mode == "structured_legal") | some_(V.LEGAL_KINDS), legal_type)
        .when(is_manual, V.ARCHETYPES[2])
        .when(F.col("_type").isin("csv", "xlsx") | mode.isin("table_preview", "sheet_preview", "table_full", "sheet_full") | some_(["sheet", "sheet_row", "table_header", "table_row"]), V.ARCHETYPES[4])
        .when((F.col("_type") == "xml") | (mode == "xml_tree") | (F.col("_root") != "") | some_(["xml_node"]), V.ARCHETYPES[5])
        .when(hits(F.col("_text12"), V.JUDICIAL_HINTS) > 0, V.ARCHETYPES[3])
        .otherwise(V.ARCHETYPES[7])
    )
    return rows.withColumn("archetype", kind).drop("_kinds", "_text5", "_text12", "_text14", "_file", "_mode", "_root", "_type")


def domain(archetype: Column, mode: Column, kinds: Column) -> Column:
    """A coarse domain of a document."""
    has = lambda wanted: _count(kinds, wanted) > 0
    return (
        F.when(archetype.isin(V.ARCHETYPES[:2]), "legal_normative")
        .when(archetype == V.ARCHETYPES[3], "judicial_document")
        .when(archetype == V.ARCHETYPES[4], "tabular_document")
        .when(archetype.isin(V.ARCHETYPES[5:7]), "structured_data_document")
        .when(has(["article", "part"]) | mode.eqNullSafe("structured_legal"), "legal_normative")
        .when(has(["table_header", "table_row", "sheet_row"]), "tabular_document")
        .when(has(["xml_node"]), "structured_data_document")
        .otherwise("general_text_document")
    )


def primary_structure(mode: Column, kinds: Column) -> Column:
    """The parser's mode, else structured_legal with legal kinds, else flat_blocks."""
    return F.coalesce(F.nullif(mode, F.lit("")), F.when(_count(kinds, V.LEGAL_KINDS) > 0, "structured_legal").otherwise("flat_blocks"))


def legislation_folder(file_name: Column, source_folder: Column) -> Column:
    """Folder of a legal file by words of its name."""
    name, folder = slug(file_name), slug(source_folder)
    return (
        F.when((folder == "normas_procedimento") | name.contains("norma_de_procedimento"), "normas_procedimento")
        .when(name.contains("lei"), "leis")
        .when(name.contains("decreto"), "decretos")
        .when(name.contains("portaria"), "portarias")
        .when(name.contains("resol") | name.contains("sumula") | name.rlike(r"(^|_)\d{1,4}_r($|_)"), "resolucoes")
        .otherwise("normas_mistas")
    )


def form_folder(file_name: Column) -> Column:
    """Folder of a form by words of its name."""
    name = slug(file_name)
    return (
        F.when(name.contains("procura"), "procuracoes")
        .when(name.rlike("visita.*tecnica|solicitacao.*de.*visita"), "visitas_tecnicas")
        .when(name.contains("aditivo"), "aditivos")
        .when(name.rlike("alteracao.*projeto|enquadramento"), "alteracao_projeto")
        .when(name.rlike("termo.*de.*acordo"), "termo_acordo")
        .otherwise("requerimentos")
    )


def revenue_folder(directory: Column) -> Column:
    name = slug(directory)
    return F.when(name.startswith("01_01_"), "adesao").when(name.startswith("02_02_"), "recolhimento_icms").when(name.startswith("03_03_"), "apuracao_escrituracao").when(name.contains("indice"), "indice").otherwise("orientacoes_gerais")


def year_folder(file_name: Column) -> Column:
    """The first year from 1900 to 2099 in a name."""
    return F.coalesce(F.nullif(F.regexp_extract(file_name, r"(?:19|20)\d{2}", 0), F.lit("")), F.lit("sem_ano_definido"))


def guide_batch(file_name: Column) -> Column:
    """Batch of a guide by its prefix; null for others, which no batch takes."""
    name = F.lower(file_name)
    return F.when(name.startswith("icms-es - "), "icms_guias").when(name.startswith("pr - "), "perguntas_respostas")
