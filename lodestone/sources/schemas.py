"""Schemas of the exchanged tables. Field names are fixed values."""

INSTRUCTION = (
    "id string, messages array<struct<role:string,content:string>>, task_type string, background string"
)
PRETRAIN_DOCUMENT = "id string, text string"
PASSAGE = "pid bigint, passage string, title string"
WIKI_PASSAGE = "id string, text string, title string"
QUERY = "qid bigint, query string"
TRIPLET = "query string, pos string, neg string"
CANDIDATE = "qid bigint, pid bigint, query string, passage string"
RANKING = "qid bigint, pid bigint, rank int"
RESPONSE = (
    "query string, topk array<struct<text:string,pid:bigint,rank:int,score:double,prob:double>>"
)
EXAM = "question string, A string, B string, C string, D string, answer string"
