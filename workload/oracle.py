"""The same results in SQL over the same tables.

The batch policies are stated another way here than in the package: next-batch pointers followed by a
recursive query, instead of a fold over length classes.
"""

from __future__ import annotations

from workload.queries import (
    BASE_TFLOP,
    BATCH,
    DOCS_PER_FILE,
    LIMIT,
    PAIR_SHIFT,
    PIECE,
    SFT_MAX,
    STEPS_PER_EPOCH,
)

# ---- pieces -----------------------------------------------------------------------------------

DOCS = r"d AS (SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\r]+'))::BIGINT AS l FROM documents)"
SORTED = "s AS (SELECT doc_id, l, row_number() OVER (ORDER BY l, doc_id) - 1 AS r FROM d)"

PAIRS = f"""
m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i,
             '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS m
      FROM conversations),
h AS (SELECT conv_id, i, m, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY i
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM m),
pairs AS (SELECT conv_id, i AS turn, conv_id * {PAIR_SHIFT} + i AS seq_id, p AS prompt, m AS chosen
          FROM h WHERE i % 2 = 1)"""

PAIR_TOKENS = f"""{PAIRS},
cut AS (SELECT seq_id, right(prompt, {SFT_MAX * 3 // 4}) AS prompt, chosen FROM pairs),
tok AS (SELECT seq_id, prompt, left(chosen, {SFT_MAX} - len(prompt)) AS chosen FROM cut),
t AS (SELECT seq_id, prompt, chosen, len(prompt)::BIGINT AS pl, len(chosen)::BIGINT AS cl,
             (len(prompt) + len(chosen))::BIGINT AS l FROM tok)"""


def codes(text: str) -> str:
    return (
        f"(CASE WHEN {text} = '' THEN []::INTEGER[] ELSE "
        f"list_transform(string_split({text}, ''), lambda c: unicode(c)) END)"
    )


def joined(ids: str) -> str:
    return f"md5(array_to_string({ids}, ','))"


def fill(value: str, n: str) -> str:
    return f"list_transform(range({n}), lambda z: {value})"


# Batches of a token capacity: from any first record, the last one that still fits.
CAPACITY = f"""{DOCS}, {SORTED},
nx AS (SELECT a.r, (SELECT coalesce(max(b.r), a.r) FROM s b
                    WHERE b.r >= a.r AND (b.r - a.r + 1) * b.l <= {LIMIT}) + 1 AS nxt FROM s a),
w AS (SELECT 0::BIGINT AS b, 0::BIGINT AS r, nxt FROM nx WHERE r = 0
      UNION ALL SELECT w.b + 1, nx.r, nx.nxt FROM w JOIN nx ON nx.r = w.nxt),
a AS (SELECT s.doc_id, s.l, w.b AS batch_id, s.r - w.r AS pos
      FROM s JOIN w ON s.r >= w.r AND s.r < w.nxt),
g AS (SELECT batch_id, count(*) AS n, max(l) AS mx, min(l) AS mn, count(*) * max(l) AS padded
      FROM a GROUP BY batch_id)"""


def difference(source: str, seq: str, diff: int, size: int) -> str:
    """CTEs from ``source(seq, l)`` to ``a(seq, l, batch_id, pos)``."""
    return f"""
s AS (SELECT {seq}, l, row_number() OVER (ORDER BY l, {seq}) - 1 AS r FROM {source}),
nx AS (SELECT a.r, (SELECT max(b.r) FROM s b WHERE b.r >= a.r AND b.r - a.r < {size}
                    AND b.l - a.l <= {diff}) + 1 AS nxt FROM s a),
w AS (SELECT 0::BIGINT AS b, 0::BIGINT AS r, nxt FROM nx WHERE r = 0
      UNION ALL SELECT w.b + 1, nx.r, nx.nxt FROM w JOIN nx ON nx.r = w.nxt),
a AS (SELECT s.{seq}, s.l, w.b AS batch_id, s.r - w.r AS pos
      FROM s JOIN w ON s.r >= w.r AND s.r < w.nxt)"""


def pieces(order: str, size: int, source: str = "d", seq: str = "doc_id") -> str:
    """CTE of the pieces of cut records, numbered through in ``order``."""
    return f"""
p AS (SELECT {seq}, l, unnest(range(greatest((l + {size} - 1) // {size}, 1))) AS chunk FROM {source}),
c AS (SELECT {seq}, chunk, CASE WHEN l > {size} THEN least(l - chunk * {size}, {size}) ELSE l END AS len,
             row_number() OVER (ORDER BY {order}, chunk) - 1 AS o FROM p)"""


PAIR_BATCHES = f"""{PAIR_TOKENS},
s AS (SELECT *, row_number() OVER (ORDER BY l, seq_id) - 1 AS r FROM t),
b AS (SELECT *, r // {BATCH} AS batch_id, r % {BATCH} AS pos,
             max(l) OVER (PARTITION BY r // {BATCH}) AS w FROM s)"""


def collated(side: str = "right", labels: bool = True, width: str = "w") -> str:
    def padded(ids: str, value: str) -> str:
        filler = fill(value, f"{width} - l")
        parts = (ids, filler) if side == "right" else (filler, ids)
        return joined(f"list_concat({parts[0]}, {parts[1]})")

    ids = codes("prompt || chosen")
    label = f"list_concat({fill('-100', 'pl')}, {codes('chosen')})"
    more = f", {padded(label, '-100')} AS labels" if labels else ""
    return f"""WITH {PAIR_BATCHES}
SELECT batch_id::BIGINT AS batch_id, pos::BIGINT AS pos, l AS n_tokens, ({width})::BIGINT AS pad_to,
       {padded(ids, '0')} AS input_ids, {padded(fill('1', 'l'), '0')} AS attention_mask{more} FROM b"""


def ordered(expression: str) -> str:
    return f"""WITH RECURSIVE {CAPACITY}
SELECT batch_id, row_number() OVER (ORDER BY {expression}) - 1 AS plan_pos, n AS n_records,
       padded::BIGINT AS padded_tokens FROM g"""


def vocabulary_tokens() -> str:
    return r"""WITH x AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r]+') AS ws FROM documents),
e AS (SELECT doc_id, unnest(ws) AS tok, unnest(range(len(ws))) AS p FROM x),
v AS (SELECT tok, row_number() OVER (ORDER BY n DESC, tok) AS id
      FROM (SELECT tok, count(*) AS n FROM e GROUP BY tok ORDER BY n DESC, tok LIMIT 2000)),
f AS (SELECT doc_id, p, coalesce(id, 0) AS id FROM e LEFT JOIN v USING (tok)),
k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (id = 0) AS u, string_agg(id::VARCHAR, ',' ORDER BY p) AS t
      FROM f GROUP BY doc_id)
SELECT x.doc_id, coalesce(n, 0) AS n_tokens, coalesce(u, 0) AS n_unknown, md5(coalesce(t, '')) AS ids
FROM x LEFT JOIN k USING (doc_id)"""


def documents_cut(expression: str, n: str = "n_tokens") -> str:
    return f"""WITH c AS (SELECT doc_id, {expression} AS t FROM documents)
SELECT doc_id, len(t)::BIGINT AS {n}, {joined(codes('t'))} AS ids FROM c"""


def exhausted(keep: bool) -> str:
    # content takes up to 256; source gets the rest; lang at most 2 of what is then left.
    spent = "{0}" if keep else "0"
    source = f"CASE WHEN 256 - a <= 0 THEN {spent.format('s')} ELSE least(s, 256 - a) END"
    lang = f"CASE WHEN least(2, 256 - a - b) <= 0 THEN {spent.format('g')} ELSE least(g, least(2, 256 - a - b)) END"
    return f"""WITH x AS (SELECT doc_id, least(len(text), 256) AS a, len(source) AS s, len(lang) AS g FROM documents),
y AS (SELECT *, {source} AS b FROM x), z AS (SELECT *, {lang} AS c FROM y)
SELECT doc_id, a::BIGINT AS content_len, b::BIGINT AS source_len, c::BIGINT AS lang_len,
       (a + b + c)::BIGINT AS total_len FROM z"""


PROBE_LENGTHS = "[" + ", ".join(str(20 * 2**i) for i in range(4, 13)) + "]"


def probes(by: str, step: int) -> str:
    group = f"GROUP BY {by}" if by else ""
    key = f"{by}, " if by else ""
    return rf"""q AS (SELECT {key}max(len(regexp_extract_all(text, '[^ \t\n\r]+')))::BIGINT AS a FROM documents {group}),
e AS (SELECT {key}a, unnest(range(a, a * 3, {step})) AS target FROM q),
f AS (SELECT {key}a, target, unnest({PROBE_LENGTHS})::BIGINT AS seq_len FROM e),
k AS (SELECT *, target // seq_len + 1 AS n_records, (target // seq_len + 1) * seq_len AS param_count FROM f),
grid AS (SELECT * FROM k WHERE param_count BETWEEN a AND a * 3)"""


LOG = f"""
log AS (SELECT event_id, event_type, event_id // 8 // {STEPS_PER_EPOCH} AS epoch, event_id // 8 % {STEPS_PER_EPOCH} AS step,
               event_id % 8 AS rank, user_id % 16 + 1 AS batch_size, length(props) AS seq_len,
               value / 10 AS normalized_loss, value AS step_time, value + 20 AS used, user_id + 5.0::DOUBLE AS free,
               {BASE_TFLOP}::DOUBLE * (user_id % 16 + 1) * length(props) / nullif(value, 0) AS tflops FROM events)"""
STEPS = """
steps AS (SELECT epoch, step, sum(batch_size)::BIGINT AS batch_size, sum(normalized_loss) / sum(batch_size) * 4 AS loss,
                 avg(step_time) AS mean_time, avg(tflops) AS mean_tflops FROM log GROUP BY epoch, step)"""

PAIR_DIFFERENCE = f"{PAIR_TOKENS}, k AS (SELECT seq_id, pl AS l FROM t), {difference('k', 'seq_id', 64, 8)}"

BUCKET = f"doc_id // {DOCS_PER_FILE} AS bucket"
FILES = f"""files AS (SELECT {BUCKET}, string_agg(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)),
                  chr(10) ORDER BY doc_id) || chr(10) AS content FROM documents GROUP BY ALL)"""

FIXED_BATCHES = f"""{DOCS}, {SORTED},
u AS (SELECT l, (row_number() OVER (ORDER BY doc_id) - 1) // {BATCH} AS b FROM d),
fixed AS (SELECT count(*) AS n, max(l) AS mx, sum(l) AS t FROM u GROUP BY b),
smart AS (SELECT count(*) AS n, max(l) AS mx, sum(l) AS t FROM s GROUP BY r // {BATCH})"""


def padding_row(name: str, table: str, padded: str = "n * mx") -> str:
    return f"""SELECT '{name}' AS plan, count(*) AS batches, sum(t)::BIGINT AS real_tokens,
       sum({padded})::BIGINT AS padded_tokens, round(1 - sum(t)::DOUBLE / sum({padded}), 6) AS waste_ratio FROM {table}"""


def template(role: str, content: str) -> str:
    return f"'<|im_start|>{role}' || chr(10) || {content} || '<|im_end|>' || chr(10)"


def plan_item(position: str) -> str:
    return f"""WITH RECURSIVE {CAPACITY},
o AS (SELECT batch_id, row_number() OVER (ORDER BY padded DESC, batch_id) - 1 AS plan_pos FROM g)
SELECT doc_id, batch_id, pos, l AS len FROM a JOIN o USING (batch_id) WHERE plan_pos = {position}"""


ORACLE: dict[str, str] = {
    "prep_conversation_pairs": f"WITH {PAIRS} SELECT conv_id, turn, prompt, chosen FROM pairs",
    "prep_question_pairs": f"""SELECT doc_id, {template('user', 'text')} AS prompt,
        {template('assistant', 'source')} AS chosen FROM documents""",
    "prep_instruction_pairs": f"""SELECT doc_id, {template('user', 'source || text')} AS prompt,
        {template('assistant', 'lang')} AS chosen FROM documents""",
    "prep_reasoning_pairs": f"""SELECT doc_id, {template('user', 'lang')} AS prompt,
        {template('assistant', 'text || source')} AS chosen FROM documents""",
    "project_fields": "SELECT doc_id, source, text AS content FROM documents",
    "source_jsonl": "SELECT doc_id, text AS content FROM documents",
    "source_json_array": "SELECT doc_id, text AS content FROM documents",
    "source_json_numbered": f"""SELECT row_number() OVER (ORDER BY (doc_id // {DOCS_PER_FILE})::VARCHAR || '/', doc_id) - 1 AS seq_id,
        doc_id, md5(text) AS text FROM documents""",
    "source_keyed_json": f"""SELECT doc_id, {template('user', 'lang')} AS prompt,
        {template('assistant', 'text || source')} AS chosen FROM documents""",
    "source_whole_text": f"WITH {FILES} SELECT bucket, content FROM files",
    "source_file_listing": f"SELECT DISTINCT {BUCKET}, true AS is_text FROM documents",
    "sink_jsonl": "SELECT doc_id, text, lang FROM documents",
    "mirror_bytes": f"WITH {FILES} SELECT bucket, md5(replace(content, ' ', '_')) AS content FROM files",
    "mirror_tree": f"WITH {FILES} SELECT bucket, md5(replace(content, ' ', '_')) AS content FROM files",
    "map_records": """SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n_lines,
        list_max(list_transform(string_split(text, chr(10)), lambda x: length(x)))::BIGINT AS longest FROM documents""",
    "source_numbered": f"""SELECT row_number() OVER (ORDER BY doc_id // {DOCS_PER_FILE} % 7, doc_id) - 1 AS seq_id,
        doc_id, md5(text) AS text FROM documents""",
    "merge_token_folder": f"""WITH a AS (SELECT doc_id AS seq_id, text FROM documents
        UNION ALL SELECT item_id + (SELECT max(doc_id) + 1 FROM documents), text FROM benchmark
        UNION ALL SELECT doc_id + (SELECT max(doc_id) + 1 FROM documents) + (SELECT max(item_id) + 1 FROM benchmark), source
                  FROM documents)
        SELECT seq_id, length(text)::BIGINT AS n_tokens, {joined(codes('text'))} AS ids FROM a""",
    "tokenize_special": f"""WITH {PAIRS},
        cut AS (SELECT seq_id, right(prompt, {SFT_MAX * 3 // 4} - 2) AS prompt, chosen FROM pairs),
        tok AS (SELECT seq_id, prompt, left(chosen, {SFT_MAX} - len(prompt) - 4) AS chosen FROM cut)
        SELECT seq_id, (len(prompt) + len(chosen) + 4)::BIGINT AS n_tokens,
               {joined(f"list_concat([6], list_concat({codes('prompt')}, [2]))")} AS prompt,
               {joined(f"list_concat([6], list_concat({codes('chosen')}, [2]))")} AS chosen FROM tok""",
    "merge_token_sets": f"""WITH a AS (SELECT doc_id AS seq_id, text FROM documents
        UNION ALL SELECT item_id + (SELECT max(doc_id) + 1 FROM documents), text FROM benchmark)
        SELECT seq_id, length(text)::BIGINT AS n_tokens, {joined(codes('text'))} AS ids FROM a""",
    "sink_plan": f"""WITH RECURSIVE {CAPACITY}
        SELECT batch_id, row_number() OVER (ORDER BY padded DESC, batch_id) - 1 AS plan_pos, n AS n_records,
               mx AS max_len, padded::BIGINT AS padded_tokens FROM g""",
    "stream_tokens": f"SELECT doc_id, length(text)::BIGINT AS n_tokens, {joined(codes('text'))} AS ids FROM documents",
    "sink_training_set": f"""WITH {PAIR_BATCHES},
        n AS (SELECT count(DISTINCT batch_id) AS n FROM b),
        o AS (SELECT unnest(range((n + 3) // 4 * 4)) AS p, n FROM n),
        d AS (SELECT p % n AS batch_id, count(*) AS times FROM o GROUP BY p % n)
        SELECT batch_id, batch_id AS plan_pos, count(*) AS n_records, (count(*) * max(w))::BIGINT AS padded_tokens,
               (count(*) * any_value(times))::BIGINT AS n_rows, max(w)::BIGINT AS width FROM b JOIN d USING (batch_id) GROUP BY batch_id""",
    "sink_training_rows": f"""WITH {PAIR_BATCHES},
        n AS (SELECT count(DISTINCT batch_id) AS n FROM b),
        o AS (SELECT unnest(range((n + 3) // 4 * 4)) AS p, n FROM n)
        SELECT p % 4 AS rank, p // 4 AS micro_step, p // 8 AS optimizer_step, batch_id, pos,
               {joined("list_concat(" + codes('prompt || chosen') + ", " + fill('0', 'w - l') + ")")} AS ids,
               {joined(f"list_concat({fill('1', 'l')}, {fill('0', 'w - l')})")} AS mask,
               {joined(f"list_concat(list_concat({fill('-100', 'pl')}, {codes('chosen')}), {fill('-100', 'w - l')})")} AS labels
        FROM o JOIN b ON p % n = batch_id""",
    "tokenize_codepoint": documents_cut("text"),
    "vocabulary": r"""WITH e AS (SELECT unnest(regexp_extract_all(text, '[^ \t\n\r]+')) AS token FROM documents)
        SELECT token, row_number() OVER (ORDER BY n DESC, token) AS id
        FROM (SELECT token, count(*) AS n FROM e GROUP BY token ORDER BY n DESC, token LIMIT 2000)""",
    "tokenize_vocabulary": vocabulary_tokens(),
    "tokenize_vocabulary_joined": vocabulary_tokens(),
    "tokenize_user_object": """SELECT doc_id, strlen(text)::BIGINT AS n_tokens,
        md5(array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'),
                 lambda h: ('0x' || h)::BIGINT), ',')) AS ids FROM documents""",
    "truncate_left": documents_cut("right(text, 256)"),
    "truncate_right": documents_cut("left(text, 256)"),
    "budget_sft": f"""WITH {PAIR_TOKENS} SELECT seq_id, pl AS prompt_len, cl AS chosen_len, l AS total_len,
        {joined(codes('prompt'))} AS prompt, {joined(codes('chosen'))} AS chosen FROM t""",
    "budget_pretrain": documents_cut("left(text, 2048)"),
    "budget_inference": documents_cut("right(text, 3996)"),
    "budget_exhausted_keep": exhausted(True),
    "budget_exhausted_empty": exhausted(False),
    "smart_sort_rank": f"WITH {DOCS}, {SORTED} SELECT doc_id, l AS len, r AS rank FROM s",
    "plan_fixed": f"""WITH {DOCS}, s AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM d)
        SELECT doc_id, l AS len, r // {BATCH} AS batch_id, r % {BATCH} AS pos FROM s""",
    "plan_fixed_sorted": f"""WITH {DOCS}, {SORTED}
        SELECT doc_id, l AS len, r // {BATCH} AS batch_id, r % {BATCH} AS pos FROM s""",
    "plan_token_capacity": f"WITH RECURSIVE {CAPACITY} SELECT doc_id, l AS len, batch_id, pos FROM a",
    "plan_length_difference": f"""WITH RECURSIVE {PAIR_DIFFERENCE}
        SELECT seq_id, l AS len, batch_id, pos FROM a""",
    "plan_length_difference_documents": f"""WITH RECURSIVE {DOCS}, {difference('d', 'doc_id', 16, 64)}
        SELECT doc_id, l AS len, batch_id, pos FROM a""",
    "plan_max_length": f"""WITH {DOCS}, {pieces('doc_id', PIECE)}
        SELECT doc_id, chunk, len, o // {BATCH} AS batch_id, o % {BATCH} AS pos FROM c""",
    "plan_max_length_sorted": f"""WITH {DOCS}, {pieces('l, doc_id', PIECE)}
        SELECT doc_id, chunk, len, o // {BATCH} AS batch_id, o % {BATCH} AS pos FROM c""",
    "plan_by_policy_name": f"""WITH RECURSIVE {CAPACITY},
        z AS (SELECT doc_id, l FROM d),
        x AS (SELECT 'LengthDifferenceRestricted' AS policy, n FROM (WITH RECURSIVE {difference('z', 'doc_id', 16, 64)}
              SELECT count(DISTINCT batch_id) AS n FROM a)),
        y AS (SELECT (count(*) + {BATCH - 1}) // {BATCH} AS n FROM (WITH {pieces('doc_id', PIECE, 'z')} SELECT * FROM c))
        SELECT 'FixedBatchSize' AS policy, (count(*) + {BATCH - 1}) // {BATCH} AS plan_item_count FROM d
        UNION ALL SELECT 'GPUMemoryRestricted', count(*) FROM g
        UNION ALL SELECT policy, n FROM x
        UNION ALL SELECT 'MaxLengthRestricted', n FROM y""",
    "plan_order_none": ordered("batch_id"),
    "plan_order_bs_asc": ordered("padded, batch_id"),
    "plan_order_bs_desc": ordered("padded DESC, batch_id"),
    "plan_order_pc_asc": ordered("padded, batch_id"),
    "plan_order_pc_desc": ordered("padded DESC, batch_id"),
    "plan_order_rc_asc": ordered("n, batch_id"),
    "plan_order_rc_desc": ordered("n DESC, batch_id"),
    "plan_order_random": ordered("md5('7:' || batch_id), batch_id"),
    "probe_grid": f"""WITH {probes('source', 500)} SELECT source, target, seq_len, n_records, param_count,
        printf('%6d: %4d * %4d', param_count, n_records, seq_len) AS summary FROM grid""",
    "probe_order": f"""WITH {probes('', 500)}
        SELECT row_number() OVER (ORDER BY param_count, target, seq_len) - 1 AS plan_pos, target, seq_len,
               n_records, param_count FROM grid""",
    "probe_rows": f"""WITH {probes('', 2000)} SELECT target, seq_len, n_records, param_count AS n_tokens,
        param_count AS n_valid FROM grid""",
    "collate_right": collated(),
    "collate_left": collated("left"),
    "collate_no_labels": collated(labels=False),
    "collate_fixed_length": collated(width="1024"),
    "collate_one_field": f"""WITH {PAIR_BATCHES}, x AS (SELECT *, max(cl) OVER (PARTITION BY batch_id) AS cw FROM b)
        SELECT batch_id, pos, cl AS n_tokens, cw AS pad_to,
               {joined("list_concat(" + codes('chosen') + ", " + fill('-100', 'cw - cl') + ")")} AS labels FROM x""",
    "collate_split_records": f"""WITH d AS (SELECT doc_id, length(text)::BIGINT AS l FROM documents),
        {pieces('doc_id', 512)},
        x AS (SELECT c.*, o // {BATCH} AS batch_id, o % {BATCH} AS pos, max(len) OVER (PARTITION BY o // {BATCH}) AS w,
                     substr(text, (chunk * 512 + 1)::BIGINT, 512) AS t FROM c JOIN documents USING (doc_id))
        SELECT batch_id, pos, len AS n_tokens, w AS pad_to,
               {joined("list_concat(" + codes('t') + ", " + fill('0', 'w - len') + ")")} AS input_ids,
               {joined(f"list_concat({fill('1', 'len')}, {fill('0', 'w - len')})")} AS attention_mask,
               {joined(f"list_concat({codes('t')}, {fill('-100', 'w - len')})")} AS labels FROM x""",
    "collate_matrices": f"""WITH {PAIR_BATCHES},
        x AS (SELECT batch_id, pos, w,
                     array_to_string(list_concat({codes('prompt || chosen')}, {fill('0', 'w - l')}), ',') AS i,
                     array_to_string(list_concat(list_concat({fill('-100', 'pl')}, {codes('chosen')}), {fill('-100', 'w - l')}), ',') AS y
              FROM b)
        SELECT batch_id, 0::BIGINT AS part, count(*) AS n_rows, max(w) AS pad_to,
               md5(string_agg(i, ',' ORDER BY pos)) AS input_ids, md5(string_agg(y, ',' ORDER BY pos)) AS labels
        FROM x GROUP BY batch_id""",
    "shard_ranks": f"""WITH RECURSIVE {CAPACITY}, n AS (SELECT count(*) AS n FROM g),
        o AS (SELECT unnest(range((n + 6) // 7 * 7)) AS p, n FROM n)
        SELECT p % n AS batch_id, p % 7 AS rank, p // 7 AS micro_step, p // 14 AS optimizer_step FROM o""",
    "shard_ranks_shuffled": f"""WITH RECURSIVE {CAPACITY},
        q AS (SELECT batch_id, row_number() OVER (ORDER BY md5('3:' || batch_id), batch_id) - 1 AS p FROM g),
        n AS (SELECT count(*) AS n FROM g), o AS (SELECT unnest(range((n + 6) // 7 * 7)) AS o, n FROM n)
        SELECT o % 7 AS rank, o // 7 AS micro_step, batch_id FROM o JOIN q ON o % n = p""",
    "step_layout": f"""WITH RECURSIVE {CAPACITY}, n AS (SELECT count(*) AS n FROM g)
        SELECT n AS n_batches, (n + 7) // 8 AS n_per_rank, ((n + 7) // 8 + 1) // 2 AS steps_per_epoch,
               ((n + 7) // 8 + 1) // 2 * 3 AS total_steps FROM n""",
    "loss_weight": f"WITH RECURSIVE {CAPACITY} SELECT batch_id, n AS n_records, n / 4.0::DOUBLE AS loss_weight FROM g",
    "token_total": f"""WITH {DOCS}, x AS (SELECT sum(l)::BIGINT AS t FROM d)
        SELECT t AS total_tokens, round(t / 1e3, 2)::DOUBLE AS thousand, round(t / 1e6, 2)::DOUBLE AS million,
               round(t / 1e9, 2)::DOUBLE AS billion FROM x""",
    "dataset_profile": f"""WITH {DOCS} SELECT source, sum(l)::BIGINT AS token_count, count(*) AS record_count,
        max(l) AS max_token_length FROM d JOIN documents USING (doc_id) GROUP BY source""",
    "plan_stats_general": f"""WITH {DOCS}, {pieces('doc_id', PIECE)}
        SELECT (count(*) + {BATCH - 1}) // {BATCH} AS plan_item_count FROM c""",
    "plan_stats_capacity": f"""WITH RECURSIVE {CAPACITY} SELECT count(*) AS plan_item_count,
        max(padded)::BIGINT AS max_padded_tokens, max(n) AS max_records, max(mx) AS max_record_length FROM g""",
    "plan_stats_length_diff": f"""WITH RECURSIVE {PAIR_DIFFERENCE},
        g AS (SELECT max(l) - min(l) AS x FROM a GROUP BY batch_id)
        SELECT count(*) AS plan_item_count, max(x) AS max_length_difference, min(x) AS min_length_difference FROM g""",
    "batch_measures": f"""WITH RECURSIVE {CAPACITY} SELECT batch_id, n AS n_records, padded::BIGINT AS padded_tokens,
        mx - mn AS length_difference FROM g""",
    "plan_preview": f"""WITH {PAIR_BATCHES},
        g AS (SELECT batch_id, row_number() OVER (ORDER BY count(*) * max(l) DESC, batch_id) - 1 AS plan_pos FROM b GROUP BY 1),
        f AS (SELECT batch_id, pos, 'prompt' AS field, {codes('prompt')} AS i FROM b
              UNION ALL SELECT batch_id, pos, 'chosen', {codes('chosen')} FROM b)
        SELECT plan_pos, batch_id, pos, field, len(i)::BIGINT AS size, array_to_string(i[1:5], ',') AS first_ids,
               array_to_string(i[greatest(len(i) - 4, 1):len(i)], ',') AS last_ids FROM f JOIN g USING (batch_id)""",
    "plan_item_first": plan_item("0"),
    "plan_item_last": plan_item("(SELECT count(*) - 1 FROM g)"),
    "padding_report": f"""WITH RECURSIVE {CAPACITY},
        u AS (SELECT l, (row_number() OVER (ORDER BY doc_id) - 1) // {BATCH} AS b FROM d),
        fixed AS (SELECT count(*) AS n, max(l) AS mx, sum(l) AS t FROM u GROUP BY b),
        smart AS (SELECT count(*) AS n, max(l) AS mx, sum(l) AS t FROM s GROUP BY r // {BATCH}),
        cap AS (SELECT count(*) AS n, max(l) AS mx, sum(l) AS t FROM a GROUP BY batch_id),
        z AS (SELECT doc_id, l FROM d),
        dif AS (SELECT * FROM (WITH RECURSIVE {difference('z', 'doc_id', 16, 64)}
                SELECT count(*) AS n, max(l) AS mx, sum(l) AS t FROM a GROUP BY batch_id))
        {padding_row('fixed', 'fixed')} UNION ALL {padding_row('fixed sorted', 'smart')}
        UNION ALL {padding_row('capacity', 'cap')} UNION ALL {padding_row('length difference', 'dif')}""",
    "padding_report_fixed_length": f"WITH {FIXED_BATCHES} {padding_row('fixed length', 'smart', 'n * 16384')}",
    "step_metrics": f"""WITH {LOG}, {STEPS} SELECT epoch, step, batch_size, round(loss, 9) AS loss,
        round(mean_time, 9) AS mean_time, round(batch_size / nullif(mean_time, 0), 9) AS records_per_second,
        round(mean_tflops, 9) AS mean_tflops FROM steps""",
    "throughput": f"""WITH {LOG} SELECT event_id, tflops,
        ({BASE_TFLOP}::DOUBLE * (4::DOUBLE / 3)) * batch_size * seq_len / nullif(step_time, 0) AS recomputed FROM log""",
    "global_step": f"WITH {LOG} SELECT event_id, epoch * {STEPS_PER_EPOCH} + step AS global_step FROM log",
    "memory_utilisation": f"""WITH {LOG} SELECT step, round(sum(used), 6) AS used,
        round(sum(used) / sum(used + free), 6) AS utilisation FROM log GROUP BY step""",
    "device_scalars": f"""WITH {LOG}, x AS (SELECT 'gpu' || rank || '_used' AS tag, used AS v FROM log
        UNION ALL SELECT 'gpu' || rank || '_free', free FROM log)
        SELECT tag, count(*) AS n, round(sum(v), 6) AS total FROM x GROUP BY tag""",
    "run_summary": f"""WITH {LOG}, {STEPS}
        SELECT round((SELECT avg(mean_tflops) FROM steps), 6) AS tflops,
               round((SELECT sum(mean_time) FROM steps), 6) AS total_time,
               round((SELECT sum(used) / (sum(used) + sum(free)) FROM log), 6) AS memory_utilisation""",
    "probe_capacity": f"""WITH {LOG} SELECT max(batch_size * seq_len)::BIGINT AS token_capacity FROM log
        WHERE used / (used + free) <= 0.6""",
    "policy_comparison": f"""WITH {LOG},
        r AS (SELECT event_type AS dataset, event_id % 2 AS run, avg(tflops) AS tf, sum(used) / sum(used + free) AS mu,
                     sum(step_time) AS ti, avg(normalized_loss) AS lo FROM log GROUP BY ALL)
        SELECT dataset, round(b.tf / a.tf, 6) AS throughput_ratio, round((b.mu - a.mu) * 100, 6) AS memory_points,
               round(b.ti / a.ti, 6) AS time_ratio, round(b.lo - a.lo, 6) AS loss_delta
        FROM r a JOIN r b USING (dataset) WHERE a.run = 0 AND b.run = 1""",
}
