"""Inline rows for tests of what the tables lack: legal acts, manuals, OFX, OCR words, paths, answers. All texts are invented here."""

from __future__ import annotations

from ..functions.values import PARSERS  # noqa: F401  the routing table that queries compare

_ACT = [
    "LEI N. 77, DE 3 DE MAIO DE 2031",
    "Dispõe sobre a taxa de uso dos portos fluviais.",
    "PARTE GERAL",
    "LIVRO I",
    "TÍTULO I",
    "CAPÍTULO I",
    "Da incidência",
    "Seção I",
    "Do fato gerador",
    "Art. 1º A taxa incide sobre o uso de portos fluviais; aplica-se também aos canais.",
    "§ 1º O imposto municipal não se confunde com a taxa.",
    "I - barcos de carga;",
    "a) com motor;",
    "1. acima de dez toneladas",
    "Parágrafo único. O regulamento definirá prazos.",
    "Art. 2º São isentos os barcos de pesca.",
    "Art. 3º A taxa será paga na forma do",
    "art. 156-A desta Lei.",
    "CAPÍTULO II",
    "Disposições finais",
    "Art. 156-A Esta Lei entra em vigor na data de sua publicação.",
]
_AMENDING = [
    "EMENDA CONSTITUCIONAL N. 9",
    "Altera o sistema de portos.",
    "Art. 1º A Constituição Federal passa a vigorar com as seguintes alterações:",
    "“Art. 145. Os portos serão fiscalizados.",
    "§ 1º Haverá registro.",
    "Art. 156-B. O imposto será anual.",
    "I - por barco;",
    "Art. 2º Ficam revogadas as disposições contrárias.",
    "Art. 3º Esta Emenda entra em vigor na data de sua publicação.",
]
_PLAIN = ["Relato de viagem pelo rio.", "Choveu durante três dias.", "O barco parou na página 3 do diário.", "Fim."]
LINES = [(1, i, t) for i, t in enumerate(_ACT, 1)] + [(2, i, t) for i, t in enumerate(_AMENDING, 1)] + [(3, i, t) for i, t in enumerate(_PLAIN, 1)]

#: A manual: title, marker, steps, an action, a list item, an interface.
MANUAL_LINES = [(1, i, t) for i, t in enumerate(["Manual do Porto", "Objetivo", "Descrever o uso do porto.", "ETAPA 1 - Entrada", "Clique em entrar", "a) primeiro item", "Portal do Porto", "ETAPA 2 - Saída", "Texto final do manual."], 1)]

OFX = [
    (1, "<OFX><BANKID>7<ACCTID>99<BANKTRANLIST>" + "".join(f"<STMTTRN><TRNTYPE>{'CREDIT' if i % 2 else 'DEBIT'}<DTPOSTED>202803{i % 28 + 1:02d}<TRNAMT>{i}.50<MEMO>Lanc {i}</STMTTRN>" for i in range(1, 204)) + "</BANKTRANLIST></OFX>"),
    (2, "<OFX><BANKTRANLIST><STMTTRN><TRNTYPE>DEBIT<DTPOSTED>20280101<TRNAMT>-3.00<MEMO>Porto</STMTTRN></BANKTRANLIST></OFX>"),
]

#: page, block, par, line, seq, text, conf, left, top, width, height
OCR_WORDS = [
    (1, 1, 1, 1, 2, "mundo", 90.0, 60, 10, 40, 12),
    (1, 1, 1, 1, 1, " ola ", 80.0, 10, 12, 40, 10),
    (1, 1, 1, 2, 3, "linha", 0.5, 10, 30, 50, 10),
    (1, 1, 1, 2, 4, "  ", 99.0, 0, 0, 900, 900),
    (1, 1, 1, 2, 5, "dois", -1.0, 70, 29, 30, 14),
    (2, 1, 1, 1, 6, "outra", 75.0, 5, 5, 20, 5),
]

PATHS = [(p,) for p in ("/a/lei.txt", "/a/B.CSV", "/a/c.tar.XLSX", "/a/.gitkeep", "/a/Thumbs.db", "/a/.DS_Store", "/a/x.bin", "/a/noext", "/a/b/foto.WEBP", "/a/p.pdf", "/a/d.docx", "/a/h.htm", "/a/o.ofx", "/a/x.xml")]

#: doc_id, file_name, file_type, mode, root_tag, transaction_count, kinds of blocks, text of the first block
ARCHETYPES = [
    (1, "extrato.ofx", "ofx", None, None, None, ["transaction"], None),
    (2, "lei 5.txt", "txt", "structured_legal", None, None, ["article", "article"], "algo"),
    (3, "emenda constitucional 9.txt", "txt", "structured_legal", None, None, ["article"], "passa a vigorar com as seguintes alteracoes"),
    (4, "guiche.pdf", "pdf", "structured_faq", None, None, ["heading"], None),
    (5, "dados.csv", "csv", "table_full", None, None, ["table_row"], "um | dois"),
    (6, "procedimentos.csv", "csv", "table_full", None, None, ["table_row"], "um"),
    (7, "nota.xml", "xml", "xml_tree", "nota", None, ["xml_node"], "um"),
    (8, "peca.txt", "txt", "line_text", None, None, ["line"], "acordao do tribunal"),
    (9, "diario.txt", "txt", "line_text", None, None, ["line"], "um dia"),
    (10, "x.txt", "txt", "line_text", None, 0, ["line"], "um dia"),
    (11, "sem.txt", "txt", "line_text", None, None, [], None),
]

BATCH_FILES = [
    ("Lei nº 10 de 1998.pdf", "normas"),
    ("Decreto 22-2004.pdf", "normas"),
    ("Portaria única.pdf", "normas"),
    ("Resolução 3.pdf", "normas"),
    ("Súmula 8 de 2011.pdf", "normas"),
    ("123_R.pdf", "normas"),
    ("Anexo.pdf", "normas"),
    ("Qualquer 1875.pdf", "normas_procedimento"),
    ("Norma de Procedimento 7.pdf", "outros"),
]

#: chunk_id, file_name, archetype, heading, text, references of heading, of text, primary reference of heading
CHUNKS = [
    ("c1", "lei.txt", "legislation_normative", "Art. 156-A - Do imposto", "Art. 156-A O imposto é anual e devido por barco de carga ou de passeio, na forma desta Lei e do regulamento.", ["156-a"], ["156-a"], "156-a"),
    ("c2", "lei.txt", "legislation_normative", "Art. 156 - Das taxas", "Art. 156 A taxa é devida por porto e por canal, na forma do regulamento e desta Lei municipal dos portos.", ["156"], ["156"], "156"),
    ("c3", "guia.txt", "manual_procedural", "Como pagar", "O imposto do art. 156-A e a taxa do art. 156 são pagos no portal.", [], ["156-a", "156"], None),
    ("c4", "diario.txt", "generic_document", "Viagem", "Choveu.", [], [], None),
    ("c5", "imposto.txt", "generic_document", "Imposto", "imposto " * 9 + "fim", [], [], None),
]

ANSWERS = [(1, "A taxa é anual [2] e devida [1], veja [2] e [9].", [1, 2, 3]), (2, "Sem fontes.", [1, 2]), (3, "Só [7].", [1])]
