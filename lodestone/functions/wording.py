"""Fixed wording: templates, special tokens and task tables.

Everything in this file is a fixed value. The texts must stay exactly as they
are, because rendered prompts are compared byte for byte.
"""

# --- special tokens -------------------------------------------------------
PAD, UNK, MASK = "[PAD]", "[UNK]", "[MASK]"
QUERY_MARK, DOC_MARK = "[Q]", "[D]"
EOS = "</s>"
PLACEHOLDER = "<DOC>"  # stands for one document vector inside a prompt

# Ids 0, 1, 2, ... in this order; vocabulary words follow.
SPECIAL_TOKENS = [PAD, UNK, MASK, QUERY_MARK, DOC_MARK, EOS, PLACEHOLDER]
# Specials that may occur inside a rendered prompt and count as one token.
PROMPT_SPECIALS = [EOS, PLACEHOLDER]

IGNORED_LABEL = -100

# --- fixed values: question, summary and fact-check templates --------------
QA_TEMPLATES = [
    "Question: {question}?\nAnswer:",
    "{question}?",
    "Answer the following question:\n\n{question}",
    "Answer this question:\n\n{question}?",
    "Please answer this question: {question}",
    "Answer the question...{question}?",
    "What is the answer to this question? {question}\n\n",
    "Can you tell me the answer to {question}?",
    "Next question: {question}\n\n",
    "Q: {question} A:",
    "{question}\nWhat is the answer?",
    "Write the answer: {question}",
    "{question}???",
]

SUMMARY_TEMPLATES = [
    "Write a short summary for the text\n\nSummary:",
    "Briefly summarize this article:\nSummary:",
    "What is a shorter version of this:\n\nSummary:",
    "Write a brief summary in a sentence or less.",
    "What is a very short summary of the above text?",
    "Summarize the aforementioned text in a single phrase.",
    "Can you generate a short summary of the above paragraph?",
    "Summarize the above articles\n\ntl;dr:",
]

FACT_CHECK_TEMPLATES = [
    'Verify the following claims with "True" or "False":\n{question}',
]

# --- fixed values: paraphrase instructions ({doc} is the placeholder run) ---
PARAPHRASE_INSTRUCTIONS = [
    "Background: {doc} means the same as",
    "Background: {doc} Can you put the above sentences in your own terms?",
    "Background: {doc} Please provide a reinterpretation of the preceding background text.",
    "These two expressions are equivalent in essence:\n(1) {doc}\n(2)",
    "Background: {doc} is a paraphrase of what?",
    "Background: {doc} Could you give me a different version of the background sentences above?",
    "In other words, background: {doc} is just another way of saying:",
    "You're getting across the same point whether you say background: {doc} or",
    "Background: {doc} After uppacking the ideas in the background information above, we got:",
    "Background: {doc} Please offer a restatement of the background sentences I've just read.",
    "Background: {doc}, which also means:",
    "Strip away the mystery, and you'll find background: {doc} is simply another rendition of:",
    "The essence of background: {doc} is captured again in the following statement:",
]

# --- fixed values: retrieval instructions -----------------------------------
RAG_INSTRUCTIONS = [
    "Refer to the background document and answer the questions.\nBackground: {background}\n",
    "Background: {background}\n",
    "To provide accurate answers, it's essential to consider the background information presented here. Contextual Background: {background}\n",
    "Background Details: {background}\n",
    "The following background will help you understand the context for the questions. Please read it carefully before responding. Background: {background}\n",
    "Background: {background}\nYou might find the above background documents helpful.\n",
]

# --- fixed values: start prompts by (task, with retrieval) --------------------
START_PROMPTS = {
    ("open_qa", True): "Refer to the background document and answer the questions:",
    ("open_qa", False): "Answer the questions:",
    ("fact_checking", True): 'Refer to the background document and verify the following claims with "True" or "False":',
    ("fact_checking", False): 'Verify the following claims with "True" or "False":',
    ("multiple_choice", True): "The following are multiple choice questions (with answers).\nPlease refer to the background document and answer the questions:",
    ("multiple_choice", False): "The following are multiple choice questions (with answers).",
}

# --- fixed values: training prompts with answers, by task ---------------------
ANSWERED_PROMPTS = {
    "open_qa": "Q: {question}?\nA: {answer}",
    "fact_checking": "Claim: {question}\nAnswer: {answer}",
    "multiple_choice": "Question: {question}\nAnswer: {answer}",
}
BACKGROUND_PREFIX = "Background: {background}\n\n"
PARAPHRASED_BACKGROUND_PREFIX = (
    "Background: {background}\nThe above background document is just a paraphrase"
    " of the following: {real_background}\n\n"
)

# --- fixed values: evaluation prompts, by task ----------------------------------
EVAL_PROMPTS = {
    "open_qa": "Question: {question}?",
    "fact_checking": "Claim: {question}",
}
ANSWER_CUE = " The answer is:"
CHAT_BACKGROUND_PREFIX = "Refer to the background document: {background}\n\n"

# --- fixed values: dataset -> (task, metric) ------------------------------------
EVAL_DATASETS = {
    "nq_open": ("open_qa", "substring_match"),
    "hotpotqa": ("open_qa", "substring_match"),
    "triviaqa": ("open_qa", "substring_match"),
    "webqa": ("open_qa", "substring_match"),
    "truthfulqa": ("open_qa", "truthfulqa_f1_rl"),
    "factkg": ("fact_checking", "fact_checking_acc"),
}

# --- fixed values: retriever -> text added before / after a passage ---------------
PASSAGE_PREFIXES = {"intfloat/e5-large-v2": "passage: "}
PASSAGE_EOS_MODELS = ["intfloat/e5-mistral-7b-instruct"]

# --- fixed values: accepted words for a fact-check verdict ------------------------
VERDICT_WORDS = {
    "True": ["supports", "yes", "true"],
    "False": ["refutes", "no", "false"],
}

UNANSWERABLE = "I don't know."
FINAL_ANSWER_CUE = "So the final answer is: "
