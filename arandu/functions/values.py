"""Word lists, weights, levels and patterns that results depend on."""

# Kinds in words, in the reports.
KIND_LABELS = {
    "preamble": "Preâmbulo",
    "part": "Parte",
    "book": "Livro",
    "title": "Título",
    "chapter": "Capítulo",
    "section": "Seção",
    "subsection": "Subseção",
    "article": "Artigo",
    "legal_paragraph": "Parágrafo",
    "inciso": "Inciso",
    "alinea": "Alínea",
    "item": "Item",
    "heading": "Cabeçalho",
    "paragraph": "Parágrafo",
    "table": "Tabela",
    "page_text": "Página",
    "line": "Linha",
    "list_item": "Item de lista",
    "xml_node": "Nó XML",
    "table_header": "Cabeçalho de tabela",
    "table_row": "Linha de tabela",
    "sheet": "Planilha",
    "sheet_row": "Linha de planilha",
    "h1": "H1",
    "h2": "H2",
    "h3": "H3",
    "p": "Parágrafo HTML",
    "li": "Item",
    "title_block": "Título",
}

# File name suffixes and the parsers that read them.
PARSERS = {
    "txt": "txt",
    "csv": "csv",
    "xlsx": "xlsx",
    "xml": "xml",
    "html": "html",
    "htm": "html",
    "ofx": "ofx",
    "pdf": "pdf",
    "docx": "docx",
    "png": "image",
    "jpg": "image",
    "jpeg": "image",
    "tif": "image",
    "tiff": "image",
    "bmp": "image",
    "webp": "image",
}
IGNORED_NAMES = [".gitkeep", ".ds_store", "thumbs.db"]

# Document archetypes.
ARCHETYPES = [
    "legislation_normative",
    "legislation_amending_act",
    "manual_procedural",
    "judicial_case",
    "spreadsheet_structured",
    "xml_structured",
    "financial_statement_ofx",
    "generic_document",
]
HEADING_KINDS = ["part", "book", "title", "chapter", "section", "subsection"]

# Levels of the normative index, and of devices quoted into an amending act.
NORMATIVE_LEVELS = {"preamble": 1, "part": 2, "book": 3, "title": 4, "chapter": 5, "section": 6, "subsection": 7, "article": 8, "legal_paragraph": 9, "inciso": 10, "alinea": 11, "item": 12}
EMBEDDED_LEVELS = {"part": 9, "book": 10, "title": 11, "chapter": 12, "section": 13, "subsection": 14, "article": 15, "legal_paragraph": 16, "inciso": 17, "alinea": 18, "item": 19}
LEGAL_KINDS = list(NORMATIVE_LEVELS)

# Hints of archetypes, in folded text.
CORE_AMENDING_HINTS = [
    "passa a vigorar com as seguintes alteracoes",
    "passam a vigorar com as seguintes alteracoes",
    "ficam alterados os seguintes dispositivos",
    "fica alterado o seguinte dispositivo",
    "a constituicao federal passa a vigorar com as seguintes alteracoes",
    "com a seguinte redacao",
    "com as seguintes alteracoes",
]
AMENDING_HINTS = [
    *CORE_AMENDING_HINTS,
    "altera a lei",
    "altera as leis",
    "altera o decreto",
    "altera os decretos",
    "acrescenta",
    "revoga",
    "renumera",
    "da nova redacao",
    "passa a vigorar com a seguinte redacao",
]
MANUAL_HINTS = ["manual", "procedimento", "procedimentos", "instrucoes", "instrucao de trabalho", "guia", "passo a passo", "fluxo operacional", "rotina operacional"]
OPERATIONAL_HINTS = ["objetivo", "objetivos", "introducao", "passos", "etapa", "etapas", "procedimento", "procedimentos", "resumo", "tela", "telas", "botao", "clique", "portal", "sistema", "acessar", "preencher", "validar", "enviar"]
JUDICIAL_HINTS = ["processo n", "autos n", "acordao", "sentenca", "decisao", "tribunal", "ementa", "relator", "apelacao", "agravo", "mandado de seguranca", "autor:", "reu:", "requerente", "requerido"]
AMENDMENT_HINTS = ["acrescenta", "altera", "com a seguinte redacao", "com as seguintes alteracoes", "da nova redacao", "fica acrescido", "passa a vigorar com", "passam a vigorar com", "renumera"]

# Words of manuals.
MARKERS = ["escopo", "etapa", "etapas", "finalidade", "fluxo", "introducao", "objetivo", "objetivos", "passo a passo", "passos", "procedimento", "procedimentos", "resumo", "visao geral"]
INTERFACE_WORDS = ["portal", "painel", "menu", "botao", "tela", "consulta", "apura"]
# What follows "Art. 5" in a mention of the article, and how an article's own text may begin in lower case.
MENTION_STARTS = ["da ", "das ", "de ", "desta ", "deste ", "do ", "dos ", "na ", "nas ", "no ", "nos ", "todos ", "todas ", "ambos ", "ambas ", "referido ", "referida ", "previsto ", "prevista ", "nos termos ", "na forma "]
OWN_STARTS = ["fica ", "ficam ", "revoga ", "revogam ", "altera ", "alteram ", "institui ", "instituem ", "dispoe ", "dispoem ", "passa ", "passam ", "entra ", "entram ", "produz ", "produzem ", "e ", "sera ", "serao ", "sao ", "compete ", "cabera ", "cabe ", "esta ", "este ", "o ", "os ", "a ", "as "]

# Patterns of legal lines; the first group is the identifier.
LEVEL_ID = r"(?:[IVXLCDM0-9]+(?:-[A-Z0-9]+)?|ÚNICA|UNICA)"
PART_ID = r"(?:[IVXLCDM0-9]+(?:-[A-Z0-9]+)?|ÚNICA|UNICA|GERAL|ESPECIAL|PRELIMINAR(?:ES)?|PRIMEIRA|SEGUNDA|TERCEIRA|QUARTA|QUINTA|SEXTA|S[ÉE]TIMA|OITAVA|NONA|D[ÉE]CIMA)"
HEADING_PATTERNS = {
    "part": (rf"PARTE\s+({PART_ID})\b", "Parte"),
    "book": (rf"LIVRO\s+({LEVEL_ID})\b", "Livro"),
    "title": (rf"T[ÍI]TULO\s+({LEVEL_ID})\b", "Título"),
    "chapter": (rf"CAP[ÍI]TULO\s+({LEVEL_ID})\b", "Capítulo"),
    "section": (rf"SE(?:ÇÃO|CAO)\s+({LEVEL_ID})\b", "Seção"),
    "subsection": (rf"SUBSE(?:ÇÃO|CAO)\s+({LEVEL_ID})\b", "Subseção"),
}
ARTICLE = r"Art\.\s*(\d+(?:-[A-Z])?(?:º|°|o)?)\.?"
SOLE_PARAGRAPH = r"Par[áa]grafo\s+[úu]nico\.?"
LEGAL_PARAGRAPH = r"§\s*(\d+(?:-[A-Z])?(?:º|°|o)?)"
INCISO = r"([IVXLCDM]+)\s*[-–]"
ALINEA = r"([a-z])\)\s*"
ITEM = r"(\d+)\s*[.)-]\s+"
LEGAL_TITLE = r"(?:LEI(?:\s+COMPLEMENTAR)?|DECRETO(?:-LEI)?|EMENDA\s+CONSTITUCIONAL|CONSTITUIÇÃO|MEDIDA\s+PROVISÓRIA|PORTARIA|RESOLUÇÃO|INSTRUÇÃO\s+NORMATIVA|CÓDIGO)\b"

# Patterns of manual lines.
NUMBERED = r"(\d+(?:\.\d+){0,4})(?:\.)?\s+(.+)"
STEP = r"(ETAPA|PASSO|FASE)\s+([0-9IVXLCDM]+)\b(?:\s*[-–:]\s*(.+))?"
LETTERED_ITEM = r"([a-z])\)\s+(.+)"
NUMBERED_ITEM = r"(\d+)[.)-]\s+(.+)"
ORDINAL_ITEM = r"(\d+(?:º|°|o)?)\s*[)\-–]\s+(.+)"
INTERFACE = r"(?:portal|painel|menu|aba|bot[aã]o|campo|tela|filtro|consulta|op[cç][aã]o|minhas apura[cç][oõ]es)\b"
ACTION = r"(?:clique|acesse|acessar|selecione|preencha|informe|digite|escolha|utilize|verifique|confira|envie|registre)\b"

# References to articles in queries and texts.
ARTICLE_MENTION = r"\bart(?:igo)?\.?\s*(\d{1,4})(?:\s*-?\s*([a-z]))?\b"
BARE_MENTION = r"\b(\d{1,4})\s*-\s*([a-z])\b"
LEADING_MENTION = r"^\s*[\"“(]*art(?:igo)?\.?\s*(\d{1,4})(?:\s*-?\s*([a-z]))?\b"

# Scores of matches.
SOURCE_PRIORITY = {"chunk": 6, "index": 5, "block": 4, "master_index": 3, "catalog": 2, "metadata": 1}
SOURCE_BOOST = {"chunk": 6, "index": 5, "block": 3, "master_index": 2, "catalog": 1, "metadata": 0}
ARCHETYPE_BONUS = {
    "legal": {"legislation_normative": 0.9, "legislation_amending_act": 0.9, "manual_procedural": 0.8, "judicial_case": 0.75, "spreadsheet_structured": 0.55, "xml_structured": 0.55, "financial_statement_ofx": 0.55},
    "generic": {"legislation_normative": 0.18, "legislation_amending_act": 0.18, "manual_procedural": 0.16, "judicial_case": 0.16, "spreadsheet_structured": 0.14, "xml_structured": 0.14, "financial_statement_ofx": 0.14},
}
OTHER_BONUS = {"legal": 0.3, "generic": 0.12}
RERANK_WEIGHTS = {
    "legal": {"textual": 42.0, "vector": 24.0, "legal_reference": 18.0, "heading": 10.0, "document_archetype": 6.0, "source_kind": 3.0, "chunk_size": 5.0},
    "generic": {"textual": 42.0, "vector": 24.0, "legal_reference": 0.0, "heading": 10.0, "document_archetype": 2.0, "source_kind": 3.0, "chunk_size": 5.0},
}
FULL_TEXT_SCORE, LEAST_COSINE, VECTOR_SIZE, LEAST_VECTOR_SIZE = 72.0, 0.12, 192, 32
PREVIEW_STOPWORDS = ["arquivo", "documento", "titulo", "capitulo", "secao", "subsecao", "parte", "livro", "manual", "procedimento"]

# PDF text: lines and phrases of viewers and signing services, which are no content.
PDF_HEADER = r"^\d+\s+N[úu]mero\s+\d+\s*[–-]\s*\d{2}/\d{2}/\d{4}$"
PDF_PAGE_NUMBER = r"^\d+$"
PDF_PAGE_LABEL = r"^page\s+\d+$"
PDF_SEPARATOR = r"^[._\-\s]{20,}$"
PDF_EXACT_LINES = ["ocultar", "pagina inicial", "proximo resultado", "proximo resultadoocultar", "resultado anterior", "resultado anterior proximo resultado", "voltar para resultado da pesquisa"]
PDF_PHRASES = [r"\bP\S*gina Inicial\b", r"\bResultado Anterior\b", r"\bPr[oó]ximo Resultado(?:Ocultar)?\b", r"\bVoltar para resultado da pesquisa\b", r"\bOcultar\b"]
PDF_HOME = r"^[Pp].{0,12}?Inicial\s+"
PDF_SIGNATURE_PAGE = r"documento original assinado eletronicamente|informações do documento|informacoes do documento"
PDF_LINES = [
    r"\bE-DOCS\s*-\s*DOCUMENTO ORIGINAL\b",
    r"^Documento original assinado eletronicamente, conforme MP 2200-2/2001",
    r"^assinado em \d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2}\s+-\d{2}:\d{2}",
    r"^Valor Legal:\s*ORIGINAL\b",
    r"\bNatureza:\s*DOCUMENTO NATO-DIGITAL\b",
    r"https://e-docs\.es\.gov\.br/",
    r"^\(assinado digitalmente\)$",
]
QUESTION = r"((?:Qual\b|Quais\b|Como\b|Quando\b|Onde\b|Quem\b|O\s+que\b|Por\s+que\b|Porque\b)[^?]{12,420}\?)"
QUESTION_ARTICLE = r"\b(?:O|A|Os|As)\b"
MANUAL_TITLE_WORDS = ["manual", "procedimento", "passo a passo", "guia"]
MANUAL_STRUCTURE_WORDS = ["objetivos", "passos", "procedimento", "etapa", "etapas", "resumo"]
MANUAL_OPERATION_WORDS = ["clique", "portal", "botão", "botao", "tela", "simulador"]
# Language codes of OCR engines.
TESSERACT_LANGUAGES = {"pt": "por", "pt-br": "por", "pt_br": "por", "en": "eng", "en-us": "eng", "en_us": "eng"}
CLOUD_LANGUAGES = {"pt-br": "pt", "pt_br": "pt", "en-us": "en", "en_us": "en"}
OCR_PROVIDERS = ["azure_vision", "rapidocr", "tesseract"]
# Transactions of an OFX file that become blocks.
OFX_BLOCKS = 200
