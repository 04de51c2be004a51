"""Limits and data-visible texts that results must carry verbatim."""

# Size limits and retrieval constants.
MAX_FILE_BYTES = 20 * 1024 * 1024
MAX_ROUNDS = 3
DEFAULT_DEPTH = 2
MAX_SUBQUESTIONS = 4
CANDIDATES = 10
FETCH_K = 30
MMR_LAMBDA = 0.9
RERANK_TOP_N = 5
CHUNK_TOKENS = 512
EMBED_BATCH = 16
EMBED_RETRIES = 2
EMBED_DIMS = 64
BM25_K1 = 1.5
BM25_B = 0.75
MAX_QUESTION_CHARS = 2000
MAX_CLARIFICATION_CHARS = 1000
MIN_QUESTION_CHARS = 3
EXCERPT_CHARS = 300
SUMMARY_CHARS = 500
REPEATED_ANSWER_CHARS = 20

# Chunking method and file type names.
CSV_CHUNKING = "csv_rows"
BLOCK_CHUNKING = "docling_hybrid"
CSV_TYPE = "csv"
CSV_ENCODINGS = ("utf-8-sig", "cp1252")
CSV_DELIMITERS = ",;\t|"
CSV_SNIFF_CHARS = 8192
PDF_TYPE = "pdf"
DEFAULT_FILENAME = "documento.pdf"

# Texts that appear in results.
ROW_LABEL = "Linha "
ROWS_LABEL = "Linhas "
PAGE_LABEL = "Página "
BLANK_COLUMN = "coluna_"
EXTRA_COLUMN = "coluna_extra_"
NO_EVIDENCE_ANSWER = "Não encontrei evidências suficientes no documento para responder a esta pergunta."
NO_EVIDENCE_REPORT = "Não encontrei evidências suficientes no documento para responder."
SEARCH_FAILED_ANSWER = "Não foi possível concluir esta subpesquisa."
SEARCH_FAILED_ERROR = "Falha ao recuperar evidências ou gerar a resposta."
NO_FINDINGS = "Nenhum achado disponível."
NONE_FEMININE = "nenhuma"
NONE_MASCULINE = "nenhum"
FOLLOW_UP_PREFIX = "Localize no documento evidências específicas para: "
REFINEMENT_PREFIX = "Localize evidências específicas para: "
ORIGINAL_REASON = "Responder diretamente à pergunta original."
PLANNED_REASON = "Localizar evidências relevantes no documento."
REFINEMENT_REASON = "Preencher lacuna apontada pela avaliação de suficiência."
UNDETAILED_GAP = "- Cobertura insuficiente não detalhada."
SUFFICIENT_REASON = "Todos os achados possuem evidências no documento."
INSUFFICIENT_REASON = "Há achados sem evidências verificáveis no documento."
LIMITATIONS_PREFIX = "Limitações da pesquisa: "
CLARIFICATIONS_HEADER = "Esclarecimentos do usuário:"
DEFAULT_CLARIFICATIONS = (
    "Qual é o objetivo principal desta pesquisa?",
    "Quais partes do documento devem receber mais atenção?",
    "Quais critérios devem orientar a análise?",
)

# Guardrail fields and messages.
QUESTION_FIELD = "pergunta"
CLARIFICATION_FIELD = "resposta de esclarecimento"
EMPTY_VIOLATION = " não pode estar vazio"
BLOCKED_VIOLATION = "o texto contém conteúdo não permitido"
ALLOWED_REASON = "A entrada respeita as regras configuradas."
SEMANTIC_UNAVAILABLE_REASON = "Validação determinística concluída; análise semântica indisponível."

# Reject details by condition.
UNSUPPORTED_FILE = (415, "Envie um arquivo PDF ou CSV.")
FILE_TOO_LARGE = (413, "O arquivo deve ter no máximo 20 MB.")
UNKNOWN_COLLECTION = (404, "Documento não encontrado. Faça o upload novamente.")
UNKNOWN_SESSION = (404, "Sessão de pesquisa não encontrada.")
SESSION_NOT_WAITING = (409, "A sessão não está aguardando esclarecimento.")
CSV_UNDECODABLE = (400, "Não foi possível decodificar o CSV. Use UTF-8 ou Windows-1252.")
CSV_EMPTY = (422, "O CSV está vazio ou possui conteúdo inválido.")
CSV_UNREADABLE = (400, "Não foi possível interpretar o arquivo CSV.")
CSV_NO_HEADER = (422, "O CSV deve possuir uma linha de cabeçalho.")
CSV_NO_ROWS = (422, "O CSV não possui linhas de dados utilizáveis.")
PDF_UNREADABLE = (400, "Não foi possível processar o PDF com o Docling.")
PDF_NO_CONTENT = (422, "O Docling não encontrou conteúdo utilizável no PDF.")
EMBED_SHORT_BATCH = (502, "O serviço de embeddings retornou um lote incompleto.")
EMBED_TIMEOUT = (504, "O serviço de embeddings excedeu o tempo limite.")
EMBED_REFUSED = (502, "O serviço de embeddings recusou a indexação do documento.")
EMBED_UNREACHABLE = (502, "Não foi possível conectar ao serviço de embeddings.")
RERANK_FAILED = (502, "Não foi possível executar o reranking.")
RERANK_INVALID = (502, "O reranking retornou uma resposta inválida.")
RERANK_NO_DOCUMENTS = (502, "O reranking não retornou documentos válidos.")
