"""Expected rows of tests on inline legal and manual texts, written from the rules of lines, index and chunks."""

from __future__ import annotations

_A1, _A2, _A3, _A156 = "Art. 1º - A taxa incide sobre o uso de portos fluviais", "Art. 2º - São isentos os barcos de pesca", "Art. 3º - A taxa será paga na forma do art. 156-A desta Lei", "Art. 156-A - Esta Lei entra em vigor na data de sua publicação"
_UP = ["Parte Geral", "Livro I", "Título I"]
_CH1, _SEC, _CH2 = "Capítulo I - Da incidência", "Seção I - Do fato gerador", "Capítulo II - Disposições finais"
_IN = [*_UP, _CH1, _SEC]
_C1, _C145, _C156, _C2, _C3 = "Art. 1º - A Constituição Federal passa a vigorar com as seguintes alterações", "Art. 145 - Os portos serão fiscalizados", "Art. 156-B - O imposto será anual", "Art. 2º - Ficam revogadas as disposições contrárias", "Art. 3º - Esta Emenda entra em vigor na data de sua publicação"
_TALE = ["Relato de viagem pelo rio.", "Choveu durante três dias.", "O barco parou na página 3 do diário.", "Fim."]


def _path(parts: list[str]) -> str | None:
    return " > ".join(parts) or None


#: kind, title, text, place in the structure, title shown in the index.
_LAW = [
    ("preamble", "Preâmbulo", "LEI N. 77, DE 3 DE MAIO DE 2031 Dispõe sobre a taxa de uso dos portos fluviais.", [], None),
    ("part", "Parte Geral", "PARTE GERAL", _UP[:1], None),
    ("book", "Livro I", "LIVRO I", _UP[:2], None),
    ("title", "Título I", "TÍTULO I", _UP, None),
    ("chapter", _CH1, "CAPÍTULO I Da incidência", _IN[:4], None),
    ("section", _SEC, "Seção I Do fato gerador", _IN, None),
    ("article", "Art. 1º", "Art. 1º A taxa incide sobre o uso de portos fluviais; aplica-se também aos canais.", [*_IN, "Art. 1º"], _A1),
    ("legal_paragraph", "§ 1º", "§ 1º O imposto municipal não se confunde com a taxa.", [*_IN, "Art. 1º", "§ 1º"], None),
    ("inciso", "Inciso I", "I - barcos de carga;", [*_IN, "Art. 1º", "§ 1º", "Inciso I"], None),
    ("alinea", "Alínea a", "a) com motor;", [*_IN, "Art. 1º", "§ 1º", "Inciso I", "Alínea a"], None),
    ("item", "Item 1", "1. acima de dez toneladas", [*_IN, "Art. 1º", "§ 1º", "Inciso I", "Alínea a", "Item 1"], None),
    ("legal_paragraph", "Parágrafo único", "Parágrafo único. O regulamento definirá prazos.", [*_IN, "Art. 1º", "Parágrafo único"], None),
    ("article", "Art. 2º", "Art. 2º São isentos os barcos de pesca.", [*_IN, "Art. 2º"], _A2),
    ("article", "Art. 3º", "Art. 3º A taxa será paga na forma do art. 156-A desta Lei.", [*_IN, "Art. 3º"], _A3),
    ("chapter", _CH2, "CAPÍTULO II Disposições finais", [*_UP, _CH2], None),
    ("article", "Art. 156-A", "Art. 156-A Esta Lei entra em vigor na data de sua publicação.", [*_UP, _CH2, "Art. 156-A"], _A156),
]
_CHANGE = [
    ("preamble", "Preâmbulo", "EMENDA CONSTITUCIONAL N. 9 Altera o sistema de portos.", [], None),
    ("article", "Art. 1º", "Art. 1º A Constituição Federal passa a vigorar com as seguintes alterações:", ["Art. 1º"], _C1),
    ("article", "Art. 145", "“Art. 145. Os portos serão fiscalizados.", ["Art. 145"], _C145),
    ("legal_paragraph", "§ 1º", "§ 1º Haverá registro.", ["Art. 145", "§ 1º"], None),
    ("article", "Art. 156-B", "Art. 156-B. O imposto será anual.", ["Art. 156-B"], _C156),
    ("inciso", "Inciso I", "I - por barco;", ["Art. 156-B", "Inciso I"], None),
    ("article", "Art. 2º", "Art. 2º Ficam revogadas as disposições contrárias.", ["Art. 2º"], _C2),
    ("article", "Art. 3º", "Art. 3º Esta Emenda entra em vigor na data de sua publicação.", ["Art. 3º"], _C3),
]
_DOCS = [(1, "legislation_normative", _LAW), (2, "legislation_amending_act", _CHANGE), (3, "generic_document", [("line", t, t, [], None) for t in _TALE])]
LEGAL_BLOCKS = [(d, a, pos, kind, title, body, _path(place), shown) for d, a, rows in _DOCS for pos, (kind, title, body, place, shown) in enumerate(rows, 1)]

#: doc_id, pos, kind, title, level, parent, titles above, last position below.
LEGAL_INDEX = [
    (d, pos, kind, title, level, parent, " > ".join([*above, title]), last)
    for d, pos, kind, title, level, parent, above, last in [
        (1, 2, "part", "Parte Geral", 2, None, [], 16),
        (1, 3, "book", "Livro I", 3, 2, _UP[:1], 16),
        (1, 4, "title", "Título I", 4, 3, _UP[:2], 16),
        (1, 5, "chapter", _CH1, 5, 4, _UP, 14),
        (1, 6, "section", _SEC, 6, 5, _IN[:4], 14),
        (1, 7, "article", _A1, 8, 6, _IN, 12),
        (1, 8, "legal_paragraph", "§ 1º", 9, 7, [*_IN, _A1], 11),
        (1, 9, "inciso", "Inciso I", 10, 8, [*_IN, _A1, "§ 1º"], 11),
        (1, 10, "alinea", "Alínea a", 11, 9, [*_IN, _A1, "§ 1º", "Inciso I"], 11),
        (1, 11, "item", "Item 1", 12, 10, [*_IN, _A1, "§ 1º", "Inciso I", "Alínea a"], 11),
        (1, 12, "legal_paragraph", "Parágrafo único", 9, 7, [*_IN, _A1], 12),
        (1, 13, "article", _A2, 8, 6, _IN, 13),
        (1, 14, "article", _A3, 8, 6, _IN, 14),
        (1, 15, "chapter", _CH2, 5, 4, _UP, 16),
        (1, 16, "article", _A156, 8, 15, [*_UP, _CH2], 16),
        (1, 1, "preamble", "Preâmbulo", 1, None, [], 1),
        (2, 1, "preamble", "Preâmbulo", 1, None, [], 1),
        (2, 2, "article", _C1, 8, None, [], 6),
        (2, 3, "article", _C145, 15, 2, [_C1], 4),
        (2, 4, "legal_paragraph", "§ 1º", 16, 3, [_C1, _C145], 4),
        (2, 5, "article", _C156, 15, 2, [_C1], 6),
        (2, 6, "inciso", "Inciso I", 17, 5, [_C1, _C156], 6),
        (2, 7, "article", _C2, 8, None, [], 7),
        (2, 8, "article", _C3, 8, None, [], 8),
        *((3, pos, "line", t, 1, None, [], pos) for pos, t in enumerate(_TALE, 1)),
    ]
]


def _text(doc: int, positions: list[int]) -> str:
    return "\n\n".join(next(rows for d, _, rows in _DOCS if d == doc)[p - 1][2] for p in positions)


#: doc_id, heading, titles above, positions, the act's article.
_CHUNKS = [
    (1, _A1, _IN, [7, 8, 9, 10, 11, 12], None),
    (1, _A2, _IN, [13], None),
    (1, _A3, _IN, [14], None),
    (1, _A156, [*_UP, _CH2], [16], None),
    (2, _C145, [_C1], [3, 4], _C1),
    (2, _C156, [_C1], [5, 6], _C1),
    (2, _C2, [], [7], None),
    (2, _C3, [], [8], None),
    (3, _TALE[0], [], [1, 2, 3], None),
    (3, _TALE[3], [], [4], None),
]
LEGAL_CHUNKS = [(d, f"chunk_{n:05d}", heading, " > ".join([*above, heading]), ",".join(map(str, at)), len(_text(d, at)), len(_text(d, at).split()), act, None) for n, (d, heading, above, at, act) in enumerate(_CHUNKS, 1)]

#: doc_id, pos, kind, title, level, group of the manual's blocks.
MANUAL_BLOCKS = [
    (1, 1, "heading", "Manual do Porto", 1, "document_title"),
    (1, 2, "heading", "Objetivo", 2, "marker"),
    (1, 3, "paragraph", "Descrever o uso do porto.", None, "body"),
    (1, 4, "heading", "Etapa 1 - Entrada", 3, "step"),
    (1, 5, "paragraph", "Clique em entrar", None, "micro_action"),
    (1, 6, "paragraph", "a) primeiro item", None, "list_item"),
    (1, 7, "paragraph", "Portal do Porto", None, "interface_label"),
    (1, 8, "heading", "Etapa 2 - Saída", 3, "step"),
    (1, 9, "paragraph", "Texto final do manual.", None, "body"),
]
_MANUAL, _GOAL = "Manual do Porto", "Objetivo"
#: doc_id, pos, title, level, parent, path, last position below.
MANUAL_INDEX = [
    (1, 1, _MANUAL, 1, None, _MANUAL, 8),
    (1, 2, _GOAL, 2, 1, f"{_MANUAL} > {_GOAL}", 8),
    (1, 4, "Etapa 1 - Entrada", 3, 2, f"{_MANUAL} > {_GOAL} > Etapa 1 - Entrada", 4),
    (1, 8, "Etapa 2 - Saída", 3, 2, f"{_MANUAL} > {_GOAL} > Etapa 2 - Saída", 8),
]
#: doc_id, chunk_id, heading, positions, group, text.
MANUAL_CHUNKS = [
    (1, "chunk_00001", _GOAL, "3", "body", "Descrever o uso do porto."),
    (1, "chunk_00002", "Etapa 1 - Entrada", "5", "micro_action", "Clique em entrar"),
    (1, "chunk_00003", "Etapa 1 - Entrada", "6", "list_item", "a) primeiro item"),
    (1, "chunk_00004", "Etapa 1 - Entrada", "7", "interface_label", "Portal do Porto"),
    (1, "chunk_00005", "Etapa 2 - Saída", "9", "body", "Texto final do manual."),
]
