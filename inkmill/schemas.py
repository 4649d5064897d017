"""The declared schemas of the engine's tables; nothing is inferred."""

from __future__ import annotations

RAW_PAPERS = "text string, meta struct<timestamp:string,yymm:string,arxiv_id:string,url:string,source:string>"
RAW_REPO_FILES = "repo string, path string, content string"
FIGURES = "file_id string, arxiv_id string, url string, caption string, code string, text_mentions array<string>"
CURATED = "file_id string, title string, description string, code string"
POSTS = "Id bigint, PostTypeId int, ParentId bigint, AcceptedAnswerId bigint, AnswerCount int, Score int, CreationDate timestamp, Title string, Tags string, Body string"
QA_FIGURES = "file_id string, description string, code string"
TEMPLATES = "template_id string, template string, terms map<string,array<string>>"
QUERIES = "query_id string, query string, code string"
CORPUS = "file_id string, archive_id string, source string, status string, log string, code string, code_new string, status_new string, log_new string, code_length int, caption string, new_caption string, text_mentions array<string>"
IMAGES = "archive_id string, file_id string, png binary"
CAPTIONS = "file_id string, new_caption string"
REPAIR_REQUESTS = "file_id string, prompt string"
REPAIR_RESPONSES = "file_id string, response string"
EVAL_GT = "figure_id string, code string, new_caption string"
PREDICTIONS = "figure_id string, tikz_pred string, compiled boolean"
VECTORS = "figure_id string, side string, patches array<array<float>>"
TOKENIZED = "input_ids array<int>, attention_mask array<int>, labels array<int>"
LICENCES = "license string, papers bigint, snippets bigint"
CORRUPT = "_corrupt_record"
