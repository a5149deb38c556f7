"""DuckDB SQL for the registered queries, written against the raw tables."""

from __future__ import annotations

from .. import constants as K

TASKS = [task for tasks in K.TASK_TYPES.values() for task in tasks]
WORD = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
CHAT = (
    r"(?:<\|begin_of_text\|>|<\|start_header_id\|>|<\|end_header_id\|>|<\|eot_id\|>"
    r"|<Image>|<Image_End>|<Caption>|<Image_Token>)|" + WORD
)


def s(value: str) -> str:
    """SQL text literal."""
    return "'" + value.replace("'", "''") + "'"


def h32(seed: str, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT)"


def u(seed: str, key: str) -> str:
    return f"({h32(seed, key)} / 4294967296.0::DOUBLE)"


def r6(expr: str) -> str:
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0::DOUBLE)"


def strip(expr: str) -> str:
    chars = " || ".join(f"chr({ord(c)})" for c in K.WHITESPACE)
    return f"trim({expr}, {chars})"


def listing(values) -> str:
    return "[" + ", ".join(s(v) for v in values) + "]"


def size16(key: str, start: int) -> str:
    return f"(CAST(('0x' || substr(md5({key}), {start}, 4))::BIGINT % 1500 + 64 AS INTEGER))"


def words(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '{WORD}')"


V_LINKS = f"""v_links AS (
  SELECT page_id, url AS image_url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS capsfusion,
         {size16('url', 1)} AS w, {size16('url', 5)} AS h
  FROM pages)"""

V_FETCH = f"""v_fetch AS (
  SELECT event_id, ts, CAST(event_id AS VARCHAR) AS identifier, user_id % 29 AS subset,
         event_id // 1000 AS batch_id, CASE WHEN {u('lost', 'event_id')} >= 0.02 THEN event_type <> 'error' END AS ok, value AS elapsed,
         event_type = 'error' AS told,
         CAST(json_extract(props, '$.k') AS INTEGER) AS k,
         CASE WHEN event_type <> 'error' AND {u('lost', 'event_id')} >= 0.02 THEN {size16('CAST(event_id AS VARCHAR)', 1)} END AS w,
         CASE WHEN event_type <> 'error' AND {u('lost', 'event_id')} >= 0.02 THEN {size16('CAST(event_id AS VARCHAR)', 5)} END AS h
  FROM events)"""

def turn_key(turn: str = "turn") -> str:
    return f"(('0x' || substr(md5(conv_id || ':' || ({turn})), 1, 15))::BIGINT)"


V_IT = f"""v_it AS (
  SELECT {turn_key()} AS sample_id, conv_id, s.text AS instruction, q.inputs, a.outputs
  FROM (SELECT conv_id, turn, text AS inputs FROM conversations WHERE role = 'user') q
  FULL JOIN (SELECT conv_id, turn - 1 AS turn, text AS outputs FROM conversations WHERE role = 'assistant') a USING (conv_id, turn)
  LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'system' GROUP BY conv_id) s USING (conv_id))"""

V_VQA = f"""v_q AS (
  SELECT {turn_key()} AS question_id, conv_id AS image_id, text AS question
  FROM conversations WHERE role = 'user'),
v_a AS (
  SELECT question_id, image_id, answer,
         CASE WHEN {u('answer_type', 'question_id')} < 0.5 THEN 'other' ELSE 'yes/no' END AS answer_type
  FROM (SELECT {turn_key('turn - 1')} AS question_id, conv_id AS image_id, text AS answer
        FROM conversations WHERE role = 'assistant')),
v_vqa AS (
  SELECT q.question_id, q.image_id, question, answer, answer_type
  FROM v_q q JOIN v_a a ON q.question_id = a.question_id AND q.image_id = a.image_id)"""

V_PAIRS = V_VQA + """,
v_pairs AS (
  SELECT question_id, image_id % 2 AS rank, image_id // 16 AS batch, question AS ref, answer AS gen FROM v_vqa)"""

V_MME = f"""v_lab AS (SELECT doc_id, quality, (row_number() OVER (ORDER BY doc_id) - 1) // 2 AS pair FROM labels),
v_mme AS (
  SELECT l.doc_id, l.pair, ({listing(TASKS)})[CAST(l.pair % {len(TASKS)} + 1 AS INTEGER)] AS category,
         CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS gt,
         CASE WHEN contains(lower(d.text), 'yes') THEN 'yes'
              WHEN contains(lower(d.text), 'no') THEN 'no' ELSE 'other' END AS pred
  FROM v_lab l JOIN documents d ON l.doc_id = d.doc_id),
v_img AS (
  SELECT category, pair, count(*) AS questions,
         count(*) FILTER (WHERE gt = pred) AS correct, count(*) FILTER (WHERE pred = 'other') AS other
  FROM v_mme GROUP BY category, pair),
v_score AS (
  SELECT category, CAST(sum(questions) AS BIGINT) AS questions, CAST(sum(correct) AS BIGINT) AS correct,
         count(*) AS images, count(*) FILTER (WHERE correct = 2) AS both_correct, CAST(sum(other) AS BIGINT) AS other,
         sum(correct)::DOUBLE / sum(questions) * 100 AS acc,
         (count(*) FILTER (WHERE correct = 2))::DOUBLE / count(*) * 100 AS acc_plus
  FROM v_img GROUP BY category)"""

V_PATCH = "v_patch AS (SELECT vec_id // 16 AS image_id, vec_id % 16 AS patch_idx, embedding FROM embeddings)"

# conversation samples with the image placeholder put in front where absent
V_CHAT = V_IT + f""",
v_chat AS (
  SELECT sample_id,
         {s(K.TRAIN_SYSTEM_PROMPT)} || coalesce(instruction, '') AS system,
         replace(CASE WHEN contains(coalesce(inputs, ''), '<IMGPLH>') THEN coalesce(inputs, '')
                      ELSE '<IMGPLH>' || coalesce(inputs, '') END,
                 '<IMGPLH>', '<Image>' || repeat('<Image_Token>', @N@) || '<Image_End>') AS usr,
         coalesce(outputs, '') AS assistant
  FROM v_it)"""

PREAMBLE = "'Cutting Knowledge Date: December 2023' || chr(10) || 'Today Date: 26 Jul 2024' || chr(10) || chr(10)"


def header(role: str) -> str:
    return f"'<|start_header_id|>{role}<|end_header_id|>' || chr(10) || chr(10)"


HEAD = f"'<|begin_of_text|>' || {header('system')} || {PREAMBLE} || {strip('system')} || '<|eot_id|>'"
USER = f"{header('user')} || {strip('usr')} || '<|eot_id|>'"
ANSWER = f"{header('assistant')} || {strip('assistant')} || chr(10) || '<|eot_id|>'"
PROMPT = f"{header('assistant')} || chr(10)"


def chat_view(n: int = K.NUM_IMAGE_TOKENS) -> str:
    return V_CHAT.replace("@N@", str(n))


BASE = K.BASE_VOCAB_SIZE
HASH_ID = f"(('0x' || substr(md5(tok), 1, 8))::BIGINT % {BASE})"
TOKEN_ID = (
    f"CASE tok WHEN '<Image>' THEN {BASE} WHEN '<Image_End>' THEN {BASE + 1} "
    f"WHEN '<Caption>' THEN {BASE + 2} WHEN '<Image_Token>' THEN {BASE + 3} ELSE {HASH_ID} END"
)


def token_view(train: bool = True, n: int = K.NUM_IMAGE_TOKENS) -> str:
    """v_tok: sample_id, pos, tok, mask of the rendered conversation."""
    if train:
        parts = [(f"{HEAD} || {USER} || {header('assistant')}", 0),
                 (f"{strip('assistant')} || chr(10)", 1), ("'<|eot_id|>'", 0)]
    else:
        parts = [(f"{HEAD} || {USER} || {PROMPT}", 0)]
    cut = ",\n".join(f"regexp_extract_all({text}, '{CHAT}') AS t{i}" for i, (text, _) in enumerate(parts))
    toks = " || ".join(f"t{i}" for i in range(len(parts)))
    mask = " || ".join(f"list_transform(t{i}, lambda x: {m})" for i, (_, m) in enumerate(parts))
    return chat_view(n) + f""",
v_cut AS (SELECT sample_id, {cut} FROM v_chat),
v_list AS (SELECT sample_id, {toks} AS toks, {mask} AS mask FROM v_cut),
v_tok AS (
  SELECT sample_id, unnest(toks) AS tok, unnest(mask) AS mask, generate_subscripts(toks, 1) - 1 AS pos FROM v_list)"""


def ngrams(side: str) -> str:
    return f"""SELECT question_id, n, array_to_string(list_slice({side}, i, i + n - 1), ' ') AS gram
    FROM v_t, (VALUES (1), (2), (3), (4)) o(n), LATERAL (SELECT unnest(range(1, len({side}) - n + 2)) AS i)"""


V_BLEU = V_PAIRS + f""",
v_t AS (SELECT question_id, {words('gen')} AS g, {words('ref')} AS r FROM v_pairs),
v_g AS (SELECT question_id, n, gram, count(*) AS c FROM ({ngrams('g')}) GROUP BY ALL),
v_r AS (SELECT question_id, n, gram, count(*) AS c FROM ({ngrams('r')}) GROUP BY ALL),
v_over AS (
  SELECT question_id, n, CAST(sum(least(coalesce(a.c, 0), coalesce(b.c, 0))) AS BIGINT) AS matches,
         CAST(sum(coalesce(a.c, 0)) AS BIGINT) AS total
  FROM v_g a FULL JOIN v_r b USING (question_id, n, gram) GROUP BY question_id, n),
v_p AS (
  SELECT t.question_id, o.n, coalesce(v.matches, 0) AS matches,
         ln(CASE WHEN coalesce(v.matches, 0) > 0 THEN v.matches ELSE 0.1::DOUBLE END
            / greatest(coalesce(v.total, 0), 1)) AS lp,
         CASE WHEN len(g) > len(r) THEN 1.0 WHEN len(g) = 0 THEN 0.0 ELSE exp(1.0 - len(r)::DOUBLE / len(g)) END AS bp
  FROM v_t t CROSS JOIN (VALUES (1), (2), (3), (4)) o(n) LEFT JOIN v_over v ON v.question_id = t.question_id AND v.n = o.n),
v_cum AS (
  SELECT question_id, n, first_value(matches) OVER w AS m1, bp, avg(lp) OVER w AS mean
  FROM v_p WINDOW w AS (PARTITION BY question_id ORDER BY n)),
v_bleu AS (
  SELECT question_id, {', '.join(
    f"max(CASE WHEN n = {n} THEN CASE WHEN m1 = 0 THEN 0.0 ELSE bp * exp(mean) END END) AS bleu_{n}" for n in (1, 2, 3, 4))}
  FROM v_cum GROUP BY question_id)"""



def blank_words(text: str) -> str:
    return f"list_filter(string_split(lower(coalesce({text}, '')), ' '), lambda x: x <> '')"


V_BLANK = V_BLEU.replace(words("gen"), blank_words("gen")).replace(words("ref"), blank_words("ref"))

BLEU_MEAN = f"""WITH {V_BLEU},
s AS (SELECT v_bleu.*, rank, batch FROM v_bleu JOIN v_pairs USING (question_id)),
b AS (SELECT rank, batch, {', '.join(f'avg(bleu_{n}) AS bleu_{n}' for n in (1, 2, 3, 4))} FROM s GROUP BY rank, batch),
r AS (SELECT rank, {', '.join(f'avg(bleu_{n}) AS bleu_{n}' for n in (1, 2, 3, 4))} FROM b GROUP BY rank)
SELECT {', '.join(r6(f'(SELECT avg(bleu_{n}) FROM r)') + f' AS bleu_{n}' for n in (1, 2, 3, 4))},
       {', '.join(r6(f'(SELECT avg(bleu_{n}) FROM s)') + f' AS row_bleu_{n}' for n in (1, 2, 3, 4))}"""

V_CENTROID = """v_dim AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
v_mean AS (SELECT label, d, avg(x) AS x FROM v_dim GROUP BY label, d),
v_norm AS (SELECT label, d, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM v_mean)"""

V_ZERO = V_CENTROID + f""",
v_item AS (SELECT vec_id AS id, d, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x
           FROM v_dim WHERE {u('broken', 'vec_id')} >= 0.02 AND {u('blank', 'vec_id')} >= 0.02),
v_logit AS (SELECT id, label, 100 * sum(i.x * n.x) AS l FROM v_item i JOIN v_norm n USING (d) GROUP BY id, label),
v_exp AS (SELECT id, CAST(label AS VARCHAR) AS label, exp(l - max(l) OVER (PARTITION BY id)) AS e FROM v_logit),
v_prob AS (SELECT id, label, e / sum(e) OVER (PARTITION BY id) AS p FROM v_exp),
v_rank AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY p DESC, label) AS INTEGER) AS rank FROM v_prob)"""

MESSAGES = f"""SELECT sample_id, 0 AS turn, 'system' AS role, system AS content FROM v_chat
UNION ALL SELECT sample_id, 1, 'user', usr FROM v_chat"""

SPLIT = f"""v_split AS (
  SELECT doc_id, source,
         CASE WHEN row_number() OVER (ORDER BY {h32('42', 'doc_id')}, doc_id)
                   <= count(*) OVER () - CAST(trunc(count(*) OVER () * 0.9::DOUBLE) AS BIGINT)
              THEN 'valid' ELSE 'train' END AS split
  FROM documents)"""

PLAN = f"""v_plan AS (
  SELECT page_id, w, h, least(w, h)::DOUBLE / greatest(w, h) AS aspect,
         CAST((greatest(w, h)::BIGINT * 448) // least(w, h) AS INTEGER) AS long_side,
         448.0::DOUBLE / greatest(w, h)::DOUBLE AS scale
  FROM v_links),
v_geo AS (
  SELECT *, CASE WHEN w <= h THEN 448 ELSE long_side END AS cw, CASE WHEN w <= h THEN long_side ELSE 448 END AS ch,
         CAST(trunc(w * scale) AS INTEGER) AS pw, CAST(trunc(h * scale) AS INTEGER) AS ph
  FROM v_plan),
v_off AS (
  SELECT *, CAST(round_even((cw - 448) / 2.0::DOUBLE, 0) AS INTEGER) AS cx, CAST(round_even((ch - 448) / 2.0::DOUBLE, 0) AS INTEGER) AS cy,
         CAST((448 - pw) // 2 AS INTEGER) AS px, CAST((448 - ph) // 2 AS INTEGER) AS py
  FROM v_geo)"""

VALID = f"""v_path AS (SELECT sample_id, 'images/' || CAST(conv_id // 3 AS VARCHAR) || '.jpg' AS image_path FROM v_it),
v_ok AS (SELECT DISTINCT image_path FROM v_path WHERE {u('valid', 'image_path')} < 0.75)"""

MESSAGE_TEXTS = [
    "HTTPSConnectionPool: Read timed out. (read Timeout=5)",
    "Failed to establish a new connection: refused",
    "404 Client Error: Not Found for url",
    "EOF occurred in SSL handshake",
    "Cannot allocate memory",
    "cannot identify image file",
]
ERRORS = ["Timeout", "Connection Error", "Not Found (404)", "SSL Error", "Memory Error", "Other"]

ERROR_TYPE = f"CASE WHEN told THEN ({listing(ERRORS)})[k % 6 + 1] ELSE 'Other' END"

RETURNED = f"""v_back AS (
  SELECT question_id, answer FROM v_a
  WHERE {u('returned', 'question_id')} < 0.8 AND {u('cut', 'question_id')} >= 0.05)"""

VOCAB = f"""v_tokens AS (SELECT doc_id, unnest({words('text')}) AS token FROM documents),
v_counts AS (SELECT token, count(*) AS n FROM v_tokens GROUP BY token),
v_vocab AS (
  SELECT token, n, row_number() OVER (ORDER BY n DESC, substr(md5(token), 1, 3), token) - 1 AS token_id FROM v_counts)"""


def padded(train: bool) -> str:
    place = "p.pos" if train else "p.pos - (p.longest - l.len)"
    return f"""WITH {token_view(train)},
v_ids AS (SELECT sample_id, pos, {TOKEN_ID} AS token_id FROM v_tok),
l AS (SELECT i.sample_id, any_value(v.conv_id) // 16 AS batch, count(*) AS len
      FROM v_ids i JOIN v_it v ON v.sample_id = i.sample_id GROUP BY i.sample_id),
m AS (SELECT batch, max(len) AS longest FROM l GROUP BY batch),
p AS (SELECT batch, longest, unnest(range(longest)) AS pos FROM m)
SELECT l.batch, l.sample_id, CAST(p.pos AS INTEGER) AS pos, CAST(coalesce(i.token_id, 128001) AS INTEGER) AS token_id,
       CASE WHEN i.token_id IS NULL THEN 0 ELSE 1 END AS attention
FROM l JOIN p ON l.batch = p.batch LEFT JOIN v_ids i ON i.sample_id = l.sample_id AND i.pos = {place}"""


def zero_shot(k: int) -> str:
    return f"WITH {V_ZERO} SELECT id, rank, label, {r6('p')} AS confidence FROM v_rank WHERE rank <= {k}"


def confusion(by: str) -> str:
    head, tail = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""SELECT {head}count(*) FILTER (WHERE gt = 'yes' AND pred = 'yes') AS tp,
  count(*) FILTER (WHERE gt = 'yes' AND pred = 'no') AS fn,
  count(*) FILTER (WHERE gt = 'no' AND pred = 'yes') AS fp,
  count(*) FILTER (WHERE gt = 'no' AND pred = 'no') AS tn,
  count(*) FILTER (WHERE pred = 'other') AS other_num,
  avg(CASE WHEN gt = pred THEN 1.0::DOUBLE ELSE 0.0 END) AS acc
FROM v_mme {tail}"""


def ratio(hit: str, other: str) -> str:
    return r6(f"CASE WHEN {hit} + {other} = 0 THEN 0.0 ELSE {hit}::DOUBLE / ({hit} + {other}) END")


LOGS = """v_log AS (
  SELECT event_id AS step, 'loss' AS name, value FROM events
  UNION ALL SELECT event_id, 'learning_rate', value / 1000 FROM events
  UNION ALL SELECT event_id, 'eval_loss', value FROM events
  UNION ALL SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS DOUBLE) FROM events)"""

REQUEST = f"""v_req AS (
  SELECT request_id, text, {u('request', 'request_id')} AS u
  FROM (SELECT {turn_key()} AS request_id, text FROM conversations WHERE role = 'user')),
v_msg AS (
  SELECT *, CASE WHEN u < 0.1 THEN '' WHEN u < 0.3 THEN {strip("'<IMGPLH>' || text")} ELSE {strip('text')} END AS m FROM v_req),
v_prompt AS (
  SELECT *, CASE WHEN m = '' THEN {s(K.SERVE_DEFAULT_PROMPT)} ELSE m || {s(K.SERVE_SUFFIX)} END AS p FROM v_msg)"""

V_DEC = V_IT + f""",
v_dec AS (SELECT sample_id, coalesce(outputs, '') AS reply, {u('decoded', 'sample_id')} AS u FROM v_it)"""

DUMP = """v_line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS turn FROM documents)"""

def _crc_table() -> list[int]:
    """What the checksum adds for each value of its last byte."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


CRC_OF_PART = f"""xor(list_reduce(list_transform(regexp_extract_all(hex(encode(part)), '..'), lambda x: ('0x' || x)::BIGINT),
    lambda c, b: xor(c >> 8, ({_crc_table()})[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"""

#: Bicubic resize as relations: taps of each (source, target) size, then columns, then rows.
SHARP = f"""v_grey AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor((x::FLOAT + 1::FLOAT)::DOUBLE * 127.5::DOUBLE)) AS v,
    CASE WHEN {u('shape', 'vec_id')} < 0.3 THEN 16 ELSE 8 END AS w, CASE WHEN {u('shape', 'vec_id')} < 0.3 THEN 4 ELSE 8 END AS h FROM embeddings),
v_shape AS (
  SELECT *, CASE WHEN crop THEN CASE WHEN w <= h THEN 32 ELSE long_side END ELSE CAST(trunc(w * scale) AS INTEGER) END AS tw,
    CASE WHEN crop THEN CASE WHEN w <= h THEN long_side ELSE 32 END ELSE CAST(trunc(h * scale) AS INTEGER) END AS th
  FROM (SELECT DISTINCT w, h, least(w, h)::DOUBLE / greatest(w, h) >= 0.6 AS crop, greatest(w, h) * 32 // least(w, h) AS long_side,
    32.0::DOUBLE / greatest(w, h) AS scale FROM v_grey)),
v_pair AS (SELECT DISTINCT w AS a, tw AS b FROM v_shape UNION SELECT h, th FROM v_shape),
v_center AS (SELECT a, b, i, (i + 0.5::DOUBLE) * (a::DOUBLE / b) AS center, greatest(a::DOUBLE / b, 1.0::DOUBLE) AS spread
  FROM v_pair, LATERAL (SELECT unnest(range(b)) AS i)),
v_near AS (SELECT *, list_transform(range(CAST(floor(4 * spread) AS BIGINT) + 3), lambda j: CAST(floor(center - 2 * spread) AS BIGINT) + j) AS n FROM v_center),
v_raw AS (SELECT *, list_transform(n, lambda p: CASE WHEN p < 0 OR p >= a THEN 0.0::DOUBLE
    WHEN abs(p + 0.5::DOUBLE - center) / spread < 1 THEN
      ((1.5::DOUBLE * (abs(p + 0.5::DOUBLE - center) / spread) - 2.5::DOUBLE) * (abs(p + 0.5::DOUBLE - center) / spread)) * (abs(p + 0.5::DOUBLE - center) / spread) + 1
    WHEN abs(p + 0.5::DOUBLE - center) / spread < 2 THEN
      -0.5::DOUBLE * ((((abs(p + 0.5::DOUBLE - center) / spread) - 5) * (abs(p + 0.5::DOUBLE - center) / spread) + 8) * (abs(p + 0.5::DOUBLE - center) / spread) - 4)
    ELSE 0.0::DOUBLE END) AS raw FROM v_near),
v_taps AS (SELECT a, b, list({{'n': list_transform(n, lambda p: greatest(0, least(p, a - 1))), 'w': list_transform(raw, lambda x: x / list_sum(raw))}} ORDER BY i) AS taps
  FROM v_raw GROUP BY a, b),
v_columns AS (
  SELECT g.vec_id, g.v, g.w, g.h, s.crop, s.tw, s.th, list_transform(range(g.h), lambda y: list_transform(t.taps, lambda p:
      greatest(0, least(255, floor(list_sum(list_transform(p.n, lambda n, j: p.w[j] * v[y * g.w + n + 1])) + 0.5::DOUBLE))))) AS rows
  FROM v_grey g JOIN v_shape s ON s.w = g.w AND s.h = g.h JOIN v_taps t ON t.a = g.w AND t.b = s.tw),
v_sharp AS (
  SELECT c.*, list_transform(t.taps, lambda p: list_transform(range(c.tw), lambda x:
      greatest(0, least(255, floor(list_sum(list_transform(p.n, lambda n, j: p.w[j] * rows[n + 1][x + 1])) + 0.5::DOUBLE))))) AS px
  FROM v_columns c JOIN v_taps t ON t.a = c.h AND t.b = c.th),
v_placed AS (
  SELECT *, CAST(CASE WHEN crop THEN -round_even((tw - 32) / 2.0::DOUBLE, 0) ELSE (32 - tw) // 2 END AS BIGINT) AS x0,
    CAST(CASE WHEN crop THEN -round_even((th - 32) / 2.0::DOUBLE, 0) ELSE (32 - th) // 2 END AS BIGINT) AS y0 FROM v_sharp),
v_canvas AS (
  SELECT *, list_transform(range(1024), lambda i: CASE WHEN i // 32 - y0 BETWEEN 0 AND th - 1 AND i % 32 - x0 BETWEEN 0 AND tw - 1
    THEN CAST(px[i // 32 - y0 + 1][i % 32 - x0 + 1] AS INTEGER) ELSE 0 END) AS canvas FROM v_placed)"""


def bytes_digest(levels: str) -> str:
    """md5 of grey levels as RGB bytes."""
    return f"md5(unhex(array_to_string(list_transform({levels}, lambda c: repeat(printf('%02X', CAST(c AS INTEGER)), 3)), '')))"


SQL = {
    "scan_links": f"WITH {V_LINKS} SELECT page_id, image_url, capsfusion FROM v_links",
    "sample_links": f"WITH {V_LINKS} SELECT page_id, image_url FROM v_links ORDER BY page_id LIMIT 100",
    "assign_identifier": f"""WITH {V_LINKS}
SELECT page_id, CASE WHEN {u('cache', 'page_id')} < 0.4 THEN 'a-' || page_id ELSE md5(image_url) END AS identifier FROM v_links""",
    "identifier_left_join": f"""WITH {V_LINKS}
SELECT page_id, image_url, CASE WHEN {u('cache', 'page_id')} < 0.4 THEN 'a-' || page_id END AS identifier FROM v_links""",
    "resume_anti_join": f"""WITH {V_LINKS}
SELECT page_id, md5(image_url) AS identifier FROM v_links
WHERE image_url NOT IN (SELECT image_url FROM v_links WHERE {u('cache', 'page_id')} < 0.4)""",
    "image_plan": f"""WITH {V_LINKS}, {PLAN}
SELECT page_id, w AS original_width, h AS original_height, {r6('aspect')} AS aspect,
  CASE WHEN aspect >= 0.6 THEN 'crop' ELSE 'pad' END AS action,
  CASE WHEN aspect >= 0.6 THEN cw ELSE pw END AS scaled_w, CASE WHEN aspect >= 0.6 THEN ch ELSE ph END AS scaled_h,
  CASE WHEN aspect >= 0.6 THEN cx ELSE px END AS offset_x, CASE WHEN aspect >= 0.6 THEN cy ELSE py END AS offset_y,
  CASE WHEN aspect >= 0.6 THEN true ELSE pw > 0 AND ph > 0 END AS valid FROM v_off""",
    "crop_geometry": f"""WITH {V_LINKS}, {PLAN}
SELECT page_id, cw AS scaled_w, ch AS scaled_h, cx AS offset_x, cy AS offset_y FROM v_off""",
    "pad_geometry": f"""WITH {V_LINKS}, {PLAN}
SELECT page_id, pw AS scaled_w, ph AS scaled_h, px AS offset_x, py AS offset_y FROM v_off""",
    "aspect_histogram": f"""WITH {V_LINKS},
b AS (SELECT CAST(least(floor(least(w, h)::DOUBLE / greatest(w, h) * 20), 19) AS INTEGER) AS bin FROM v_links)
SELECT bin, count(*) AS images, {r6('bin / 20.0::DOUBLE')} AS low, {r6('(bin + 1) / 20.0::DOUBLE')} AS high FROM b GROUP BY bin""",
    "base64_roundtrip": f"""SELECT doc_id,
  CASE WHEN {u('base64', 'doc_id')} >= 0.1 THEN CAST(strlen(text) AS INTEGER) ELSE 0 END AS n_bytes,
  CASE WHEN {u('base64', 'doc_id')} >= 0.1 THEN md5(text) END AS digest FROM documents""",
    "data_url_decode": "SELECT doc_id, md5(from_base64(base64(encode(text)))) AS digest FROM documents",
    "keep_fetched": f"""WITH {V_FETCH}
SELECT identifier, w AS original_width, h AS original_height FROM v_fetch WHERE ok""",
    "download_report": f"""WITH {V_FETCH},
t AS (SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS good, sum(elapsed) FILTER (WHERE ok) AS secs,
        (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE AS wall,
        count(*) FILTER (WHERE ok AND least(w, h)::DOUBLE / greatest(w, h) >= 0.6) AS crops,
        count(*) FILTER (WHERE ok AND least(w, h)::DOUBLE / greatest(w, h) < 0.6) AS pads FROM v_fetch)
SELECT total AS total_images, good AS downloaded, total - good AS failed, {r6('good::DOUBLE / total * 100')} AS success_rate,
  {r6('secs / good')} AS average_seconds, {r6('wall')} AS total_seconds, {r6('good / wall')} AS images_per_second,
  {r6('good / secs')} AS theoretical_images_per_second, crops AS center_cropped, pads AS padded FROM t""",
    "error_types": f"""WITH {V_FETCH}
SELECT {ERROR_TYPE} AS error_type, count(*) AS n_errors FROM v_fetch WHERE ok IS NOT TRUE GROUP BY 1""",
    "ingest_progress": f"""WITH {V_FETCH}
SELECT subset, count(*) AS total, count(*) FILTER (WHERE ok) AS processed,
  CAST(floor((count(*) FILTER (WHERE ok)) * 100 / count(*)) AS BIGINT) AS percent,
  max(batch_id) FILTER (WHERE ok) AS latest_batch FROM v_fetch GROUP BY subset""",
    "caption_prompts": f"""SELECT page_id, ({listing(K.CAPTION_PROMPTS)})[CAST(floor({u('caption', 'page_id')} * 20) AS INTEGER) + 1] AS inputs FROM pages""",
    "adapt_pretrain": f"""WITH {V_LINKS}
SELECT 'Caption the image.' AS instruction,
  ({listing(K.CAPTION_PROMPTS)})[CAST(floor({u('caption', 'md5(image_url)')} * 20) AS INTEGER) + 1] AS inputs,
  capsfusion AS outputs, 'images/' || md5(image_url) || '.jpg' AS image_path FROM v_links""",
    "subset_union": f"""WITH {V_LINKS}, {V_IT}
SELECT 'captions' AS subset, page_id AS position, NULL AS instruction, NULL AS inputs, capsfusion AS outputs FROM v_links
UNION ALL SELECT 'dialogs', row_number() OVER (ORDER BY sample_id) - 1, instruction, inputs, outputs FROM v_it
UNION ALL SELECT 'texts', doc_id, NULL, text, NULL FROM documents""",
    "offset_image_ids": f"""WITH {V_IT},
n AS (SELECT (SELECT count(*) FROM documents) AS d, (SELECT count(*) FROM pages) AS p)
SELECT 'texts' AS subset, doc_id AS position, doc_id AS image_id FROM documents
UNION ALL SELECT 'captions', page_id, page_id + d FROM pages, n
UNION ALL SELECT 'dialogs', i, i + d + p FROM (SELECT row_number() OVER (ORDER BY sample_id) - 1 AS i FROM v_it), n""",
    "dense_image_ids": """SELECT source AS subset, doc_id AS position, row_number() OVER (ORDER BY source, doc_id) - 1 AS image_id FROM documents""",
    "mix_prompt": f"""WITH {V_IT},
d AS (SELECT sample_id, coalesce(instruction, '') AS a, coalesce(inputs, '') AS b, outputs, {u('mix', 'sample_id')} AS u FROM v_it)
SELECT sample_id, CASE WHEN u < 0.66 THEN '' ELSE a END AS instruction,
  CASE WHEN u < 0.33 THEN b || a WHEN u < 0.66 THEN a || b ELSE b END AS inputs, outputs FROM d""",
    "mix_prompt_distribution": f"""SELECT CASE WHEN {u('mix', 'doc_id')} < 0.33 THEN 'inputs+instruction'
  WHEN {u('mix', 'doc_id')} < 0.66 THEN 'instruction+inputs' ELSE 'unchanged' END AS kind, count(*) AS n_rows
FROM documents GROUP BY 1""",
    "keep_valid": f"WITH {V_IT}, {VALID} SELECT sample_id, image_path FROM v_path WHERE image_path IN (SELECT image_path FROM v_ok)",
    "validation_summary": f"""WITH {V_IT}, {VALID}
SELECT count(*) AS initial_rows, count(*) FILTER (WHERE image_path IN (SELECT image_path FROM v_ok)) AS valid_rows,
  count(*) FILTER (WHERE image_path NOT IN (SELECT image_path FROM v_ok)) AS removed_rows FROM v_path""",
    "ensure_placeholder": f"""WITH {V_IT},
d AS (SELECT sample_id, CASE WHEN {u('placed', 'sample_id')} < 0.3 THEN 'Look: <IMGPLH> ' || inputs ELSE inputs END AS t FROM v_it)
SELECT sample_id, CASE WHEN contains(coalesce(t, ''), '<IMGPLH>') THEN t ELSE '<IMGPLH>' || coalesce(t, '') END AS inputs FROM d""",
    "expand_placeholder": f"WITH {chat_view()} SELECT sample_id, usr AS inputs FROM v_chat",
    "to_messages": f"WITH {chat_view()} {MESSAGES} UNION ALL SELECT sample_id, 2, 'assistant', assistant FROM v_chat",
    "generation_messages": f"WITH {chat_view()} {MESSAGES}",
    "normalize_conversation": f"""WITH {DUMP}
SELECT doc_id, 0 AS turn, 'system' AS role, 'You are a powerful visual assistant.' AS content FROM documents
UNION ALL
SELECT doc_id, CAST(turn AS INTEGER), (['user', 'assistant', 'tool'])[CAST((turn - 1) % 3 + 1 AS INTEGER)],
  replace(CASE WHEN turn = 1 THEN '<image>' ELSE '' END || line, '<image>', '<IMGPLH>') FROM v_line""",
    "normalize_turns": """SELECT DISTINCT conv_id, CAST(-1 AS BIGINT) AS turn, 'system' AS role, 'You are a powerful visual assistant.' AS content FROM conversations
UNION ALL SELECT conv_id, turn, role, '<IMGPLH>' || text FROM conversations""",
    "alpaca_messages": f"""WITH {V_IT}
SELECT sample_id, 0 AS turn, 'system' AS role, 'You are a powerful visual assistant.' AS content FROM v_it
UNION ALL SELECT sample_id, 1, 'user', inputs FROM v_it UNION ALL SELECT sample_id, 2, 'assistant', outputs FROM v_it""",
    "vqa_join": f"WITH {V_VQA} SELECT question_id, image_id, question, answer AS multiple_choice_answer, answer_type FROM v_vqa",
    "vqa_prompts": f"""WITH {V_VQA}
SELECT image_id, 'VQA/' || image_id AS image_path,
  '<sys>You are a useful Visual Assitant</sys><user>' || question || '</user><assist>'
  || CASE WHEN answer_type = 'other' THEN 'It''s ' ELSE '' END || answer || '</assist>' AS prompt FROM v_vqa""",
    "render_chat_train": f"WITH {chat_view()} SELECT sample_id, {HEAD} || {USER} || {ANSWER} AS text FROM v_chat",
    "render_chat_eval": f"WITH {chat_view()} SELECT sample_id, {HEAD} || {USER} || {PROMPT} AS text FROM v_chat",
    "render_inference": f"""WITH {V_VQA},
v_ask AS (SELECT question_id, 'You are a powerful visual assistant.' AS system,
  replace('<IMGPLH>' || question, '<IMGPLH>', '<IMAGE>' || repeat('<Image_Token>', 64) || '<IMAGE_END>') AS usr FROM v_q)
SELECT question_id, {HEAD} || {USER} || {PROMPT} AS text FROM v_ask""",
    "prepare_requests": f"""WITH {REQUEST}
SELECT request_id, CASE WHEN u > 0.2 AND NOT contains(p, '<IMGPLH>') THEN '<IMGPLH>' || p ELSE p END AS prompt,
  CASE WHEN u > 0.2 AND u <= 0.95 THEN md5(text) END AS image_digest,
  CASE WHEN u > 0.95 THEN {s(K.SERVE_IMAGE_ERROR)} END AS error FROM v_prompt""",
    "word_tokens": f"""WITH t AS (SELECT doc_id, {words('text')} AS t FROM documents)
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM t""",
    "build_vocab": f"""WITH {VOCAB}
SELECT token, n, token_id FROM v_vocab
UNION ALL SELECT ({listing([t for _, t in K.ADDED_TOKENS])})[i + 1], 0, (SELECT count(*) FROM v_counts) + i
FROM (SELECT unnest(range(4)) AS i)""",
    "vocab_token_ids": f"""WITH {VOCAB}
SELECT doc_id, count(*) AS n_tokens, CAST(sum(token_id) AS BIGINT) AS id_sum, max(token_id) AS id_max
FROM v_tokens JOIN v_vocab USING (token) GROUP BY doc_id""",
    "assistant_mask": f"""WITH {token_view()}
SELECT sample_id, CAST(pos AS INTEGER) AS pos, CAST({TOKEN_ID} AS INTEGER) AS token_id, mask FROM v_tok""",
    "label_mask": f"""WITH {token_view()},
m AS (SELECT sample_id, pos, tok, CASE WHEN mask = 1 OR lag(mask) OVER (PARTITION BY sample_id ORDER BY pos) = 1 THEN 1 ELSE 0 END AS mask FROM v_tok)
SELECT sample_id, CAST(pos AS INTEGER) AS pos, mask, CAST(CASE WHEN mask = 1 THEN {TOKEN_ID} ELSE -100 END AS INTEGER) AS label FROM m""",
    "pad_right": padded(True),
    "pad_left": padded(False),
    "collate_batches": f"""WITH {V_IT}
SELECT conv_id // 16 AS batch, string_agg(CAST(sample_id AS VARCHAR), '|' ORDER BY sample_id) AS sample_ids,
  string_agg(coalesce(inputs, ''), '|' ORDER BY sample_id) AS inputs, string_agg(coalesce(outputs, ''), '|' ORDER BY sample_id) AS outputs
FROM v_it GROUP BY 1""",
    "align_patches": f"""WITH {token_view(n=16)}, {V_PATCH},
i AS (SELECT sample_id, pos, row_number() OVER (PARTITION BY sample_id ORDER BY pos) - 1 AS rank FROM v_tok WHERE tok = '<Image_Token>')
SELECT i.sample_id, CAST(rank AS INTEGER) AS patch_rank, CAST(pos AS INTEGER) AS position,
  {r6('list_sum(list_transform(embedding, lambda x: x::DOUBLE))')} AS embedding_sum
FROM i JOIN v_it v ON v.sample_id = i.sample_id JOIN v_patch p ON p.image_id = v.conv_id AND p.patch_idx = rank""",
    "train_split": f"WITH {SPLIT} SELECT doc_id, source FROM v_split WHERE split = 'train'",
    "valid_split": f"WITH {SPLIT} SELECT doc_id, source FROM v_split WHERE split = 'valid'",
    "split_counts": f"WITH {SPLIT} SELECT split, count(*) AS n_rows FROM v_split GROUP BY split",
    "rendered_prompts": f"""WITH {V_IT},
d AS (SELECT sample_id, coalesce(instruction, '') AS a, coalesce(inputs, '') AS b, coalesce(outputs, '') AS assistant, {u('mix', 'sample_id')} AS u,
  row_number() OVER (ORDER BY {h32('42', 'sample_id')}, sample_id) AS rn, count(*) OVER () AS n FROM v_it),
v_mixed AS (SELECT sample_id, assistant, rn, n, {s(K.TRAIN_SYSTEM_PROMPT)} || CASE WHEN u < 0.66 THEN '' ELSE a END AS system,
  CASE WHEN u < 0.33 THEN b || a WHEN u < 0.66 THEN a || b ELSE b END AS t FROM d),
v_ready AS (SELECT *, replace(CASE WHEN contains(t, '<IMGPLH>') THEN t ELSE '<IMGPLH>' || t END, '<IMGPLH>',
  '<Image>' || repeat('<Image_Token>', 64) || '<Image_End>') AS usr FROM v_mixed)
SELECT sample_id, CASE WHEN rn <= n - CAST(trunc(n * 0.9::DOUBLE) AS BIGINT) THEN 'valid' ELSE 'train' END AS split,
  {HEAD} || {USER} || {ANSWER} AS text FROM v_ready""",
    "llm_requests": f"""WITH {V_VQA}
SELECT CAST(question_id AS VARCHAR) AS custom_id,
  CAST(to_json({{'custom_id': CAST(question_id AS VARCHAR), 'method': 'POST', 'url': '/v1/chat/completions',
    'body': {{'model': 'gpt-4o-mini', 'messages': [
      {{'role': 'system', 'content': {s(K.AUGMENT_SYSTEM_PROMPT)}}},
      {{'role': 'user', 'content': {s(K.AUGMENT_PROMPT)} || ' Question: ' || question || '. Answer: ' || answer}}],
      'max_tokens': 128}}}}) AS VARCHAR) AS request FROM v_vqa""",
    "llm_request_batches": f"""WITH {V_VQA},
r AS (SELECT question_id, (row_number() OVER (ORDER BY question_id) - 1) // 50 AS batch FROM v_vqa)
SELECT batch, count(*) AS n_requests, min(question_id) AS first_id, max(question_id) AS last_id FROM r GROUP BY batch""",
    "llm_response_text": f"WITH {V_VQA}, {RETURNED} SELECT CAST(question_id AS VARCHAR) AS custom_id, answer FROM v_back",
    "llm_response_structured": f"""WITH {V_VQA}, {RETURNED}
SELECT CAST(question_id AS VARCHAR) AS custom_id, answer FROM v_back WHERE {u('json', 'question_id')} < 0.5""",
    "llm_last_wins": """SELECT CAST(conv_id AS VARCHAR) AS custom_id, arg_max(text, turn) AS answer
FROM conversations WHERE role = 'assistant' GROUP BY conv_id""",
    "augmentation_join": f"""WITH {V_VQA}, {RETURNED}
SELECT v.question_id, question, b.answer AS complete_answer, CASE WHEN b.answer IS NULL THEN 'missing' ELSE 'answered' END AS status
FROM v_vqa v LEFT JOIN v_back b ON b.question_id = v.question_id""",
    "augmentation_coverage": f"""WITH {V_VQA}, {RETURNED}
SELECT CASE WHEN b.answer IS NULL THEN 'missing' ELSE 'answered' END AS status, count(*) AS n_samples
FROM v_vqa v LEFT JOIN v_back b ON b.question_id = v.question_id GROUP BY 1""",
    "l2_normalize": f"""WITH d AS (SELECT vec_id, unnest(embedding)::DOUBLE * (vec_id + 1) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT vec_id, CAST(dim AS INTEGER) AS dim, {r6('x / sqrt(sum(x * x) OVER (PARTITION BY vec_id))')} AS value FROM d""",
    "cosine_to_reference": f"""WITH {V_CENTROID}
SELECT vec_id, {r6('sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x)))')} AS cosine
FROM v_dim a JOIN v_mean b ON a.d = b.d AND b.label = 0 GROUP BY vec_id""",
    "zero_shot_top1": f"WITH {V_ZERO} SELECT id, label, {r6('p')} AS confidence FROM v_rank WHERE rank = 1",
    "zero_shot_top3": zero_shot(3),
    "zero_shot_blocked": zero_shot(3),
    "zero_shot_label_blocks": zero_shot(3),
    "class_distribution": f"""WITH {V_ZERO}
SELECT label, count(*) AS items, {r6('avg(p)')} AS mean_confidence FROM v_rank WHERE rank = 1 GROUP BY label""",
    "pool_patches": f"""WITH {V_PATCH},
d AS (SELECT image_id, patch_idx // 4 // 2 * 2 + patch_idx % 4 // 2 AS cell, unnest(embedding)::DOUBLE AS x,
        generate_subscripts(embedding, 1) - 1 AS dim FROM v_patch)
SELECT image_id, CAST(cell AS INTEGER) AS cell, CAST(dim AS INTEGER) AS dim, {r6('avg(x)')} AS value FROM d GROUP BY image_id, cell, dim""",
    "label_last_wins": """SELECT 'label_' || label AS label, 'description of line ' || max(vec_id) AS description FROM embeddings GROUP BY label""",
    "extract_reply": f"WITH {V_DEC} SELECT sample_id, CASE WHEN u >= 0.1 THEN reply END AS reply FROM v_dec",
    "eval_prompt": f"""WITH {V_VQA}
SELECT question_id, '<IMGPLH>' || question AS prompt, '<IMGPLH>' || question || {s(K.REASONING_SUFFIX)} AS reasoning_prompt FROM v_q""",
    "format_answers": f"""SELECT source AS category, doc_id || '.jpg' AS img_name, lang AS question, 'Yes' AS gt_ans,
  {strip("replace(text, chr(10), '')")} AS pred_ans FROM documents""",
    "parse_yes_no": """SELECT doc_id, CASE WHEN contains(lower(text), 'yes') THEN 'yes' WHEN contains(lower(text), 'no') THEN 'no' ELSE 'other' END AS pred FROM documents""",
    "mme_scores": f"WITH {V_MME} SELECT category, questions, correct, other, {r6('acc')} AS acc, {r6('acc + acc_plus')} AS score FROM v_score",
    "mme_acc_plus": f"WITH {V_MME} SELECT category, images, both_correct, {r6('acc_plus')} AS acc_plus FROM v_score",
    "mme_rollup": f"""WITH {V_MME},
t AS (SELECT CASE WHEN list_contains({listing(K.TASK_TYPES['Perception'])}, category) THEN 'Perception' ELSE 'Cognition' END AS eval_type,
        acc + acc_plus AS score FROM v_score)
SELECT eval_type, {r6('sum(score)')} AS score, count(*) AS tasks FROM t GROUP BY eval_type
UNION ALL SELECT 'total', {r6('sum(score)')}, count(*) FROM t""",
    "confusion": f"WITH {V_MME}, c AS ({confusion('category')}) SELECT category, tp, fn, fp, tn, other_num, {r6('acc')} AS acc FROM c",
    "confusion_overall": f"""WITH {V_MME}, c AS ({confusion('')})
SELECT tp, fn, fp, tn, other_num, {r6('acc')} AS acc, {ratio('tp', 'fp')} AS precision, {ratio('tp', 'fn')} AS recall FROM c""",
    "precision_recall": f"""WITH {V_MME}, c AS ({confusion('category')})
SELECT category, {ratio('tp', 'fp')} AS precision, {ratio('tp', 'fn')} AS recall FROM c""",
    "ngram_overlap": f"WITH {V_BLEU} SELECT question_id, CAST(n AS INTEGER) AS n, matches, total FROM v_over",
    "bleu_of_blank_words": f"""WITH {V_BLANK}
SELECT t.question_id, CAST(len(g) AS INTEGER) AS gen_len, CAST(len(r) AS INTEGER) AS ref_len, {', '.join(
    f"CAST(coalesce((SELECT matches FROM v_over v WHERE v.question_id = t.question_id AND v.n = {n}), 0) AS BIGINT) AS matches_{n}, "
    f"CAST(greatest(len(g) - {n - 1}, 0) AS BIGINT) AS total_{n}" for n in (1, 2))} FROM v_t t""",
    "bleu_sentence": f"""WITH {V_BLEU}
SELECT question_id, {', '.join(r6(f'bleu_{n}') + f' AS bleu_{n}' for n in (1, 2, 3, 4))} FROM v_bleu""",
    "bleu_batch_mean": BLEU_MEAN,
    "evaluate_captions": BLEU_MEAN,
    "metric_series": """WITH p AS (SELECT 'run' || (user_id % 3) AS run, event_type AS tag, event_id AS step, value FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY run, tag ORDER BY step) AS rn FROM p)
SELECT run, tag, step, value FROM r WHERE rn > 1""",
    "metric_series_joined": """SELECT 'run' || (user_id % 3) AS run, event_id AS step,
  max(value) FILTER (WHERE event_type = 'view') AS view, max(value) FILTER (WHERE event_type = 'click') AS click
FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2""",
    "metric_routing": f"""WITH {LOGS}
SELECT step, CASE WHEN name IN ('loss', 'learning_rate') THEN 'training/' ELSE 'other/' END || name AS tag,
  {r6('value')} AS value, 'eval_' || name AS prefixed FROM v_log WHERE NOT starts_with(name, 'eval_')""",
    "metric_routing_eval": f"WITH {LOGS} SELECT step, 'evaluation/' || name AS tag, {r6('value')} AS value FROM v_log",
    "nested_questions": f"""WITH {DUMP}
SELECT ('0x' || substr(md5(doc_id || ':' || (turn - 1)), 1, 15))::BIGINT AS question_id, doc_id AS image_id, line AS question FROM v_line""",
    "answers_json": f"""WITH {DUMP}
SELECT turn - 1 AS ord, source || '/' || v.doc_id AS question_id, 'Is it ' || line AS question, 'Yes' AS gt_ans, line AS pred_ans
FROM v_line v JOIN documents d ON d.doc_id = v.doc_id WHERE {u('torn', 'v.doc_id')} >= 0.05
UNION ALL SELECT -1, NULL, NULL, NULL, NULL FROM documents WHERE {u('torn', 'doc_id')} < 0.05""",
    "header_size": f"WITH {V_LINKS} SELECT page_id, w AS width, h AS height FROM v_links",
    "fetched_sizes": f"""WITH {V_FETCH}
SELECT event_id, identifier, w AS original_width, h AS original_height FROM v_fetch WHERE ok AND {u('outcome', 'identifier')} < 0.75""",
    "failed_downloads": f"""WITH {V_FETCH}
SELECT 'http://h/' || identifier AS url, identifier, CASE WHEN told THEN ({listing(MESSAGE_TEXTS)})[k % 6 + 1] END AS error FROM v_fetch WHERE ok IS NOT TRUE""",
    "report_text": f"""WITH {V_FETCH},
t AS (SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS good, sum(elapsed) FILTER (WHERE ok) AS secs,
        count(*) FILTER (WHERE ok AND least(w, h)::DOUBLE / greatest(w, h) >= 0.6) AS crops,
        count(*) FILTER (WHERE ok AND least(w, h)::DOUBLE / greatest(w, h) < 0.6) AS pads FROM v_fetch),
e AS (SELECT {ERROR_TYPE} AS error_type, count(*) AS n FROM v_fetch WHERE ok IS NOT TRUE GROUP BY 1)
SELECT array_to_string(['Download Report', repeat('=', 50), 'Total images processed: ' || total, 'Successfully downloaded: ' || good,
  'Failed downloads: ' || (total - good), format('Success rate: {{:.2f}}%', good::DOUBLE / total * 100),
  format('Average download time per image: {{:.2f}} seconds', secs / good), 'Total processing time: 1000.00 seconds',
  format('Processing speed: {{:.2f}} images/second', good / 1000.0::DOUBLE),
  format('Theoretical max speed: {{:.2f}} images/second', good / secs),
  'Images center cropped: ' || crops, 'Images padded with black: ' || pads, repeat('=', 50), 'Common error types:']
  || (SELECT list('  - ' || error_type || ': ' || n ORDER BY '  - ' || error_type || ': ' || n) FROM e), chr(10)) AS value FROM t""",
    "batch_predict": f"SELECT vec_id, {r6('list_sum(list_transform(embedding, lambda x: x::DOUBLE))')} AS total FROM embeddings",
    "durable_inference": f"""SELECT vec_id, CASE WHEN vec_id % 50 <> 7 THEN {r6('list_sum(list_transform(embedding, lambda x: x::DOUBLE))')} END AS total,
  CAST(CASE WHEN vec_id % 50 <> 7 THEN len(embedding) ELSE -1 END AS INTEGER) AS dims, CASE WHEN vec_id % 50 = 7 THEN 'no such vector' END AS error FROM embeddings""",
    "embed_images": """SELECT doc_id, CAST(strlen(text) AS DOUBLE) AS length,
  CAST(('0x' || substr(hex(encode(text)), 1, 2))::BIGINT AS DOUBLE) AS first FROM documents""",
    "llm_augment": f"""WITH {V_VQA},
r AS (SELECT question_id, (row_number() OVER (ORDER BY question_id) - 1) // 50 AS batch FROM v_vqa)
SELECT CAST(question_id AS VARCHAR) AS custom_id, 'batch ' || batch AS answer, batch, NULL AS error FROM r WHERE batch <> 1
UNION ALL SELECT DISTINCT NULL, NULL, batch, 'batch failed' FROM r WHERE batch = 1""",
    "tokenizer_hook": f"""WITH {chat_view()},
p AS (SELECT sample_id, [length({HEAD}), length({header('user')}), length({strip('usr')}), 10,
        length({header('assistant')}), length({strip('assistant')}) + 1, 10] AS n FROM v_chat)
SELECT sample_id, CAST(generate_subscripts(n, 1) - 1 AS INTEGER) AS pos, CAST(unnest(n) AS INTEGER) AS token_id,
  CASE WHEN generate_subscripts(n, 1) = 6 THEN 1 ELSE 0 END AS mask FROM p""",
    "collate_hook": """SELECT doc_id, doc_id // 16 AS batch, CAST(length(text) AS BIGINT) AS n_chars,
  CAST(max(length(text)) OVER w - length(text) AS BIGINT) AS n_padding, count(*) OVER w AS n_rows
FROM documents WINDOW w AS (PARTITION BY doc_id // 16)""",
    "resample_images": f"""WITH {SHARP}
SELECT CAST(vec_id AS VARCHAR) AS identifier, CAST(32 AS INTEGER) AS width, CAST(32 AS INTEGER) AS height,
  CASE WHEN crop THEN 'crop' ELSE 'pad' END AS action, {bytes_digest('canvas')} AS digest FROM v_canvas""",
    "resample_transforms": f"""WITH {SHARP}
SELECT CAST(vec_id AS VARCHAR) AS identifier, CAST(CASE WHEN crop THEN w ELSE 32 END AS INTEGER) AS width,
  CAST(CASE WHEN crop THEN h ELSE 32 END AS INTEGER) AS height, CASE WHEN crop THEN 'crop' ELSE 'pad' END AS action,
  CASE WHEN crop THEN {bytes_digest('list_transform(range(w * h), lambda i: 255 - v[i // w * w + w - i % w])')}
    ELSE {bytes_digest('canvas')} END AS digest FROM v_canvas""",
    "header_formats": f"WITH {V_LINKS} SELECT page_id, CAST(page_id % 6 AS INTEGER) AS kind, w AS width, h AS height FROM v_links",
    "offset_masks": f"""WITH {chat_view()},
v_text AS (SELECT sample_id, {HEAD} || {USER} || {header('assistant')} AS head, {strip('assistant')} || chr(10) AS body FROM v_chat),
v_five AS (SELECT sample_id, head || body || '<|eot_id|>' AS text, length(head) AS low, length(head) + length(body) AS high FROM v_text),
v_part AS (SELECT *, a, substr(text, a + 1, 5) AS part FROM v_five, LATERAL (SELECT unnest(range(0, length(text), 5)) AS a)),
v_in AS (SELECT sample_id, a, part, a < high AND low < a + length(part) AS inside FROM v_part),
v_ext AS (SELECT *, CASE WHEN inside OR lag(inside) OVER (PARTITION BY sample_id ORDER BY a) THEN 1 ELSE 0 END AS mask FROM v_in)
SELECT sample_id, CAST(count(*) AS INTEGER) AS n_tokens, md5(string_agg(CAST(mask AS VARCHAR), '' ORDER BY a)) AS mask_digest,
  CAST(sum(CASE WHEN mask = 1 THEN {CRC_OF_PART} % {K.BASE_VOCAB_SIZE} ELSE 0 END) AS BIGINT) AS label_sum FROM v_ext GROUP BY sample_id""",
    "ingest_stream": "SELECT url AS image_url, md5(url) AS identifier, CAST(length(url) AS INTEGER) AS original_width, CAST(0 AS BIGINT) AS batch_id FROM pages",
    "stream_counts": "SELECT CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, count(*) AS n_rows FROM events GROUP BY 1",
    "serve_requests": f"""WITH {REQUEST},
f AS (SELECT request_id, u, CASE WHEN u > 0.2 AND NOT contains(p, '<IMGPLH>') THEN '<IMGPLH>' || p ELSE p END AS prompt FROM v_prompt)
SELECT CAST(request_id AS VARCHAR) AS request_id, CASE WHEN u > 0.95 THEN {s(K.SERVE_IMAGE_ERROR)} ELSE md5(prompt) END AS response FROM f""",
}
