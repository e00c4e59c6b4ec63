"""Training examples: chunks, label masks, paired views, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import chat, wording
from ..functions.binding import let
from ..functions.choice import fill, pick
from ..functions.text import last_subsequence, strip, tokenize
from .ordering import id_bucket, prefix_aggregates, range_bucket, seeded_shuffle, with_position
from .vocabulary import SPECIAL_IDS, encode

IGNORED = wording.IGNORED_LABEL
EXAMPLE = "struct<input_tokens:array<string>,labels:array<string>>"


# --- chunks ---------------------------------------------------------------


def chunk_tokens(tokens: Column, total_max: int = 1024, single_max: int = 180, single_min: int = 20) -> Column:
    """Token list cut at ``total_max`` and split into chunks of ``single_max``.

    The last chunk is dropped when it has at most ``single_min`` tokens and is
    not the only one. An empty list gives one empty chunk, as an error upstream
    would hide the row.
    """

    def split(v):
        starts = F.sequence(F.lit(1), F.greatest(F.size(v["kept"]), F.lit(1)), F.lit(single_max))
        tail = F.pmod(F.size(v["kept"]) - 1, F.lit(single_max)) + 1
        keep = F.size(starts) - F.when((F.size(starts) > 1) & (tail <= single_min), 1).otherwise(0)
        return F.transform(
            F.slice(starts, F.lit(1), keep), lambda s: F.slice(v["kept"], s, F.lit(single_max))
        )

    return let(split, kept=F.slice(tokens, 1, total_max))


def chunk_count(tokens: Column, total_max: int = 1024, single_max: int = 180, single_min: int = 20) -> Column:
    """How many chunks :func:`chunk_tokens` gives, without building them."""

    def count(v):
        n = v["n"]
        full = F.greatest(F.ceil(n / single_max).cast("int"), F.lit(1))
        tail = F.pmod(n - 1, F.lit(single_max)) + 1
        return full - F.when((full > 1) & (tail <= single_min), 1).otherwise(0)

    return let(count, n=F.least(F.size(tokens), F.lit(total_max)))


def split_background(df: DataFrame, keys: list[str], tokens: Column, **limits) -> DataFrame:
    """(keys, chunk_no, chunk) with one row per chunk."""
    return df.select(*keys, F.posexplode(chunk_tokens(tokens, **limits)).alias("chunk_no", "chunk"))


# --- label masks -------------------------------------------------------------


def quiet_head(tokens: Column, quiet: Column) -> Column:
    """Labels: the tokens, with the first ``quiet`` entries ignored."""
    ignored = F.array_repeat(F.lit(str(IGNORED)), F.least(quiet, F.size(tokens)))
    rest = F.slice(tokens, quiet + 1, F.greatest(F.size(tokens), F.lit(1)))
    return F.concat(ignored, rest)


def live_labels(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x.cast("string") != str(IGNORED)))


def has_live_label(labels: Column) -> Column:
    return F.exists(labels, lambda x: x.cast("string") != str(IGNORED))


def same_live_labels(labels: Column, other: Column) -> Column:
    return live_labels(labels) == live_labels(other)


def run_start(tokens: Column, run: Column) -> Column:
    """:func:`last_subsequence`, for runs that may be empty: an empty one lies behind the last token."""
    return F.when(F.size(run) == 0, F.size(tokens)).otherwise(last_subsequence(tokens, run))


def span_labels(tokens: Column, answer: Column, background: Column | None = None) -> Column:
    """Labels that keep the last occurrence of the answer (and of the background)
    plus, when the answer is found, the last position. All else is ignored.
    An answer or a background without tokens is found, and covers nothing."""

    def inside(i, start, length):
        return (start >= 0) & (i >= start) & (i < start + length)

    def labels(v):
        def label(x, i):
            keep = inside(i, v["answer_at"], v["answer_len"])
            keep = keep | ((v["answer_at"] >= 0) & (i == v["last"]))
            if background is not None:
                keep = keep | inside(i, v["background_at"], v["background_len"])
            return F.when(keep, x).otherwise(F.lit(str(IGNORED)))

        return F.transform(v["tokens"], label)

    values = {
        "tokens": tokens,
        "last": F.size(tokens) - 1,
        "answer_at": run_start(tokens, answer),
        "answer_len": F.size(answer),
    }
    if background is not None:
        values["background_at"] = run_start(tokens, background)
        values["background_len"] = F.size(background)
    return let(labels, **values)


def answer_example(
    prompt: Column, answer: Column, background: Column | None = None, max_len: int = 1024
) -> Column:
    """struct(input_tokens, labels) of a prompt that holds its answer.

    Labels are the last occurrence of the answer, of the background if given,
    and the last token when the answer is found within ``max_len`` tokens.
    """

    def labelled(v):
        labels = span_labels(v["tokens"], v["answer"], v["background"] if background is not None else None)
        return F.struct(v["tokens"].alias("input_tokens"), labels.alias("labels"))

    values = {
        "tokens": F.slice(chat.message_tokens(prompt), 1, max_len),
        "answer": chat.message_tokens(answer),
    }
    if background is not None:
        values["background"] = chat.message_tokens(background)
    return let(labelled, **values)


def turn_spans(turns: DataFrame, conversation: str, turn: str, style: chat.ChatStyle, bits: int = 16) -> DataFrame:
    """Rendered turns with the place of each one in its conversation.

    ``turns`` has one row per message (conversation, turn, role, content). The
    result adds ``segment`` and its character and token ranges; the segments of
    a conversation, joined by turn, are the rendered chat. A conversation of any
    length stays one row per turn, so no task has to hold it whole.
    """
    rendered = turns.withColumn("segment", chat.render_message(F.col("role"), F.col("content"), style))
    measured = rendered.withColumn("n_tokens", F.size(chat.message_tokens(F.col("segment"))))
    return prefix_aggregates(
        measured,
        [conversation],
        [F.col(turn)],
        id_bucket(F.col(turn), bits),
        {
            "char_start": ("sum", F.length("segment").cast("bigint")),
            "token_start": ("sum", F.col("n_tokens").cast("bigint")),
            "_previous": ("max", F.struct(turn, "role")),
        },
    ).withColumn("previous_role", F.col("_previous")["role"]).drop("_previous")


def chat_label_mask(
    turns: DataFrame, conversation: str, turn: str, style: chat.ChatStyle, max_len: int = 1024
) -> DataFrame:
    """(conversation, input_tokens, labels) cut at ``max_len`` tokens.

    Labels equal the tokens on assistant turns and the ignored label elsewhere.
    Only turns that start before the cut are gathered, so a gathered list never
    exceeds ``max_len`` tokens plus one turn.
    """
    spans = turn_spans(turns, conversation, turn, style).filter(F.col("token_start") < max_len)
    room = (F.lit(max_len) - F.col("token_start")).cast("int")
    tokens = F.slice(chat.message_tokens(F.col("segment")), F.lit(1), room)
    quiet = chat.quiet_tokens(F.col("role"), F.col("previous_role"), F.size("tokens"), style)
    pieces = spans.withColumn("tokens", tokens).withColumn("labels", quiet_head(F.col("tokens"), quiet))
    gathered = pieces.groupBy(conversation).agg(
        F.array_sort(F.collect_list(F.struct(turn, "tokens", "labels"))).alias("_turns")
    )
    return gathered.select(
        conversation,
        F.flatten(F.transform("_turns", lambda t: t["tokens"])).alias("input_tokens"),
        F.flatten(F.transform("_turns", lambda t: t["labels"])).alias("labels"),
    )


def messages_label_mask(messages: Column, style: chat.ChatStyle = chat.INSTRUCT, max_len: int = 1024) -> Column:
    """struct(input_tokens, labels) of a chat held in one row."""

    def piece(m, previous):
        def labelled(v):
            quiet = chat.quiet_tokens(v["role"], v["previous"], F.size(v["tokens"]), style)
            return F.struct(v["tokens"].alias("tokens"), quiet_head(v["tokens"], quiet).alias("labels"))

        tokens = chat.message_tokens(chat.render_message(m["role"], m["content"], style))
        return let(labelled, tokens=tokens, role=m["role"], previous=previous)

    def whole(v):
        tokens = F.flatten(F.transform(v["pieces"], lambda p: p["tokens"]))
        labels = F.flatten(F.transform(v["pieces"], lambda p: p["labels"]))
        return F.struct(
            F.slice(tokens, 1, max_len).alias("input_tokens"), F.slice(labels, 1, max_len).alias("labels")
        )

    roles = F.transform(messages, lambda m: m["role"])
    shifted = F.concat(F.array(F.lit(None).cast("string")), F.slice(roles, F.lit(1), F.size(roles) - 1))
    with_previous = F.zip_with(
        messages, shifted, lambda m, p: F.struct(m.alias("m"), p.alias("previous"))
    )
    pieces = F.transform(with_previous, lambda x: piece(x["m"], x["previous"]))
    return F.when(
        F.size(messages) == 0, F.raise_error(F.lit("a chat needs at least one message")).cast(EXAMPLE)
    ).otherwise(let(whole, pieces=pieces))


def join_prompt(prompt: Column, completion: Column) -> Column:
    """Prompt and completion joined by a space unless white space is there already."""
    left, right = strip(prompt), strip(completion)
    spaced = left.rlike(r"[ \n\t]$") | right.rlike(r"^[ \n\t]")
    return F.when(spaced, F.concat(left, right)).otherwise(F.concat(left, F.lit(" "), right))


def prompt_completion(background: Column, prompt: Column, completion: Column, max_len: int = 1024) -> Column:
    """struct(input_tokens, labels): background and prompt are masked, the
    completion and the end-of-text token keep their labels."""
    full_prompt = strip(F.concat(fill(F.lit(wording.BACKGROUND_PREFIX), background=background), prompt))
    example = F.concat(join_prompt(full_prompt, completion), F.lit(wording.EOS))
    return prompt_masked(example, full_prompt, max_len)


def prompt_masked(example: Column, prompt: Column, max_len: int) -> Column:
    """struct(input_tokens, labels) of ``example``, which starts with ``prompt``."""

    def labelled(v):
        return F.struct(
            v["tokens"].alias("input_tokens"), quiet_head(v["tokens"], v["quiet"]).alias("labels")
        )

    tokens = F.slice(chat.message_tokens(example), 1, max_len)
    return let(labelled, tokens=tokens, quiet=F.size(chat.message_tokens(prompt)))


def example_ids(df: DataFrame, keys: list[str], example: str, vocabulary: DataFrame) -> DataFrame:
    """(keys, ids, labels): an example of tokens as numbers. A label is the id
    of its token, or IGNORED."""
    rows = df.select(*keys, F.col(f"{example}.input_tokens").alias("_tokens"), F.col(f"{example}.labels").alias("_labels"))
    live = F.transform("_labels", lambda x: x != str(IGNORED))
    encoded = encode(rows.withColumn("_live", live), [*keys, "_live"], F.col("_tokens"), vocabulary)
    labels = F.zip_with("ids", "_live", lambda i, on: F.when(on, i).otherwise(F.lit(IGNORED)))
    return encoded.select(*keys, "ids", labels.alias("labels"))


# --- example builders -----------------------------------------------------------


def paraphrase_messages(document: Column, key: Column, seed, embed_len: int = 1) -> Column:
    """Chat that asks to restate a placeholder and answers with the document."""
    instruction = fill(
        pick(wording.PARAPHRASE_INSTRUCTIONS, seed, key), doc=chat.placeholder_run(embed_len)
    )
    return chat.conversation(instruction, strip(document))


def paraphrase_completion(
    document: Column, key: Column, seed, embed_len: int = 1, max_len: int = 336
) -> Column:
    """struct(input_tokens, labels): instruction masked, document kept.

    Placeholders are never labels, also where the document itself holds one.
    """
    instruction = fill(
        pick(wording.PARAPHRASE_INSTRUCTIONS, seed, key), doc=chat.placeholder_run(embed_len)
    )

    def labelled(v):
        quiet = F.lit(str(IGNORED))
        labels = F.transform(
            v["tokens"],
            lambda x, i: F.when((i < v["head"]) | (x == wording.PLACEHOLDER), quiet).otherwise(x),
        )
        return F.struct(v["tokens"].alias("input_tokens"), labels.alias("labels"))

    head = chat.message_tokens(instruction)
    tokens = F.slice(F.concat(head, chat.message_tokens(strip(document))), 1, max_len)
    return let(labelled, tokens=tokens, head=F.size(head))


def dual_views(
    messages: Column,
    background: Column,
    embed_len: int = 1,
    max_len: int = 1024,
    single_max: int = 180,
    tokens: Column | None = None,
) -> tuple[Column, Column]:
    """(compressed, plain) messages of one example.

    The first user message refers to the background: as one placeholder run
    per chunk in the compressed view, as full text in the plain view.
    ``tokens`` are those of the background, where they are known.
    """
    tokens = tokenize(background) if tokens is None else tokens
    chunks = chunk_count(tokens, total_max=max_len, single_max=single_max)
    compressed = fill(
        F.lit(wording.CHAT_BACKGROUND_PREFIX), background=chat.placeholder_run(chunks * embed_len)
    )
    plain = fill(F.lit(wording.CHAT_BACKGROUND_PREFIX), background=background)
    return chat.prefix_first_user(messages, compressed), chat.prefix_first_user(messages, plain)


def encoded_views(
    messages: Column,
    background: Column,
    embed_len: int = 1,
    max_len: int = 1024,
    chunk_len: int = 180,
    match_views: bool = True,
) -> Column:
    """An array of no or one struct(chunks, compressed, plain): both views of an
    example as tokens and labels, and the background in chunks. There is none
    where the plain view has no label, or where the views differ in how many they have and
    ``match_views`` is set.

    Meant for ``F.inline``: the background and each view are tokenised once,
    as no filter is pushed below a generator.
    """

    def chosen(v):
        live = live_labels(v["plain"]["labels"])
        good = live > 0
        if match_views:
            good = good & (live == live_labels(v["compressed"]["labels"]))
        return F.filter(F.array(v), lambda _: good)

    def views(v):
        compressed, plain = dual_views(v["messages"], v["background"], embed_len, max_len, chunk_len, v["tokens"])
        return let(
            chosen,
            chunks=chunk_tokens(v["tokens"], max_len, chunk_len),
            compressed=messages_label_mask(compressed, max_len=max_len),
            plain=messages_label_mask(plain, max_len=max_len),
        )

    def bound(v):
        return let(views, messages=v["messages"], background=v["background"], tokens=tokenize(v["background"]))

    return let(bound, messages=messages, background=background)


def answered_prompt(
    task: Column,
    question: Column,
    answer: Column,
    background: Column | None = None,
    real_background: Column | None = None,
) -> Column:
    """Start prompt plus the answered question of a task.

    With ``background`` it is put in front; with ``real_background`` the text
    also says what the background paraphrases.
    """
    with_background = background is not None
    case = None
    for name, template in wording.ANSWERED_PROMPTS.items():
        start = wording.START_PROMPTS[(name, with_background)]
        if real_background is not None:
            # the real text is filled in last but one, as it may hold anything
            body = start + "\n\n" + wording.PARAPHRASED_BACKGROUND_PREFIX + template
        elif with_background:
            body = start + "\n\n" + wording.BACKGROUND_PREFIX + template
        else:
            body = start + template
        case = F.when(task == name, F.lit(body)) if case is None else case.when(task == name, F.lit(body))
    values = {"question": question, "answer": answer, "background": background, "real_background": real_background}
    return _fill_once(case, {k: strip(v) for k, v in values.items() if v is not None})


def _fill_once(template: Column, values: dict[str, Column]) -> Column:
    """Fill all names in one pass, so that braces inside a value stay as they are.

    The template is cut at its fields first; values are put between the pieces.
    """
    pieces = F.split(template, r"(?=\{)|(?<=\})")

    def value(piece):
        case = None
        for name, column in values.items():
            hit = piece == "{" + name + "}"
            case = F.when(hit, column) if case is None else case.when(hit, column)
        return case.otherwise(piece)

    return F.array_join(F.transform(pieces, value), "")


def instructed_prompt(prompt: Column, background: Column, key: Column, seed) -> Column:
    """A retrieval instruction chosen by key, filled and put before the prompt."""
    return F.concat(fill(pick(wording.RAG_INSTRUCTIONS, seed, key), background=background), strip(prompt))


# --- batches -----------------------------------------------------------------------


def with_batch(
    df: DataFrame,
    key: str,
    batch_size: int,
    seed,
    epoch: int = 0,
    shuffle: bool = True,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add ``batch`` and ``slot`` after a seeded shuffle (or in key order).

    Places are found from the keys alone. Where ``df`` is costly to compute,
    ``source`` names a table with the same keys to read them from.
    """
    keys = (df if source is None else source).select(key)
    placed = (
        seeded_shuffle(keys, key, seed, epoch)
        if shuffle
        else with_position(keys, [F.col(key)], range_bucket(keys, key))
    )
    places = placed.select(
        key,
        F.floor(F.col("position") / batch_size).alias("batch"),
        F.pmod("position", F.lit(batch_size)).cast("int").alias("slot"),
    )
    return df.join(places, key)


def pad_to(values: Column, width: Column, filler, side: str) -> Column:
    gap = F.array_repeat(F.lit(filler), width - F.size(values))
    return F.concat(gap, values) if side == "left" else F.concat(values, gap)


def collate(
    batched: DataFrame, ids: str = "ids", labels: str = "labels", pad_id: int | str = 0, side: str = "left"
) -> DataFrame:
    """Pad ids and labels to the longest row of the batch and add the attention
    mask. Rows may hold numbers or tokens."""
    ignored = str(IGNORED) if dict(batched.dtypes)[labels] == "array<string>" else IGNORED
    width = F.max(F.size(ids)).over(Window.partitionBy("batch"))
    padded = (
        batched.withColumn("_width", width)
        .withColumn(labels, pad_to(F.col(labels), F.col("_width"), ignored, side))
        .withColumn(ids, pad_to(F.col(ids), F.col("_width"), pad_id, side))
    )
    mask = F.transform(ids, lambda x: (x != pad_id).cast("int"))
    return padded.withColumn("attention_mask", mask).drop("_width")


def trim_padding(batched: DataFrame, ids: str = "ids", pad_id: int = 0) -> DataFrame:
    """Cut fixed-width rows to the longest count of non-pad ids in their batch."""
    used = F.size(F.filter(ids, lambda x: x != pad_id))
    longest = F.max(used).over(Window.partitionBy("batch"))
    return batched.withColumn("_longest", longest).withColumn(
        ids, F.slice(F.col(ids), F.lit(1), F.col("_longest"))
    ).drop("_longest")


def stack_documents(batched: DataFrame, positive: str, negative: str, name: str = "ids") -> DataFrame:
    """(batch, place, ids): the positives of a batch in slot order, then its negatives."""
    size = F.count("*").over(Window.partitionBy("batch")).cast("int")
    sides = F.array(
        F.struct(F.col("slot").alias("place"), F.col(positive).alias(name)),
        F.struct((F.col("slot") + F.col("_size")).alias("place"), F.col(negative).alias(name)),
    )
    return batched.withColumn("_size", size).select("batch", F.inline(sides))


def batch_targets(batched: DataFrame, key: str, batch_size: int, devices: int = 1) -> DataFrame:
    """In-batch contrastive targets: for each query the place of its own document.

    A device stacks the positives of its batch and then the hard negatives; the
    documents of all devices of one step follow each other. The target of slot
    ``i`` on device ``g`` is therefore ``i + g * documents per device``; every
    other document of the step is a negative. Targets replace the pair table,
    which would hold every query with every document.
    """
    size = F.count("*").over(Window.partitionBy("batch"))
    rows = batched.withColumn("_size", size).withColumn("step", F.floor(F.col("batch") / devices))
    device = F.pmod("batch", F.lit(devices))
    documents = F.sum("_two").over(Window.partitionBy("step"))
    return (
        rows.withColumn("_two", F.lit(2).cast("bigint"))
        .withColumn("documents", documents)
        .select(
            "step",
            device.cast("int").alias("device"),
            "slot",
            F.col(key),
            (F.col("slot") + device * (2 * batch_size)).cast("bigint").alias("target"),
            (F.col("documents") - 1).alias("negatives"),
        )
    )
