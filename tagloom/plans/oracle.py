"""Independent SQL for the named queries, written for DuckDB."""

from __future__ import annotations

from tagloom.operators.features import ARRAYS
from tagloom.plans.corpus import CLASSES, LABELS, TRANSITIONS
from tagloom.plans.registry import BIAS, WEIGHTS

# --- shared pieces of SQL ---------------------------------------------------

LINES = """ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  unnest(range(len(string_split(text, chr(10))))) AS sent_id FROM documents),
sw AS (SELECT doc_id, sent_id, list_filter(string_split(line, ' '), lambda w: w <> '') AS words FROM ln),
sent AS (SELECT doc_id, sent_id, words, len(words) AS n FROM sw WHERE len(words) > 0),
tok AS (SELECT doc_id, sent_id, unnest(words) AS word, unnest(range(n)) AS word_pos FROM sent)"""

TAGGED = (
    LINES
    + """,
ent AS (SELECT *, length(word) >= 9 AS ent FROM tok),
nb AS (SELECT *, coalesce(lag(ent) OVER w, false) AS pe, coalesce(lead(ent) OVER w, false) AS ne FROM ent
  WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY word_pos)),
gd AS (SELECT doc_id, sent_id, word_pos, word, doc_id*31 + sent_id*17 + word_pos*7 AS k,
  CASE WHEN NOT ent THEN 'O' ELSE (CASE WHEN pe AND ne THEN 'I-' WHEN pe THEN 'E-' WHEN ne THEN 'B-' ELSE 'S-' END)
  || (CASE WHEN doc_id % 2 = 0 THEN 'Chemical' ELSE 'Disease' END) END AS gold FROM nb),
tagged AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'O' WHEN k % 13 = 0 THEN 'S-Gene' ELSE gold END AS pred,
  CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'devel' ELSE 'test' END AS split FROM gd)"""
)

_IDS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in LABELS.items())
_NAMES = " ".join(f"WHEN {v} THEN '{k}'" for k, v in LABELS.items() if k != "X")


def _id(tag: str) -> str:
    return f"CASE {tag} {_IDS} ELSE 0 END"


def _name(id_: str) -> str:
    return f"CASE {id_} {_NAMES} ELSE 'O' END"


VOCAB = """low AS MATERIALIZED (SELECT lower(word) AS w, count(*) AS n FROM tok GROUP BY 1),
ch AS (SELECT c, sum(n) AS n FROM (SELECT n, unnest(string_split(w, '')) AS c FROM low) GROUP BY c HAVING sum(n) >= 50),
en AS (SELECT right(w, 3) AS c, sum(n) AS n FROM low WHERE length(w) >= 6 GROUP BY 1 HAVING sum(n) >= 10),
entries AS (SELECT * FROM (VALUES (0,'0','[PAD]'),(0,'1','[UNK]'),(0,'2','[CLS]'),(0,'3','[SEP]'),(0,'4','[MASK]')) t(cl, o, piece)
  UNION ALL SELECT 1, c, c FROM ch UNION ALL SELECT 2, '##' || c, '##' || c FROM ch
  UNION ALL SELECT 3, w, w FROM low WHERE n >= 5 AND length(w) BETWEEN 2 AND 12
  UNION ALL SELECT 4, '##' || c, '##' || c FROM en),
vocab AS MATERIALIZED (SELECT piece, row_number() OVER (ORDER BY cl, o) - 1 AS id FROM entries)"""


def _walk(tokens: str) -> str:
    """Greedy longest match over a table ``tokens(token)``."""
    return f"""spans AS (SELECT token, s, unnest(range(s + 1, length(token) + 1)) AS e
  FROM (SELECT token, unnest(range(length(token))) AS s FROM {tokens})),
best AS MATERIALIZED (SELECT token, s, max(e) AS e FROM spans JOIN vocab
  ON vocab.piece = (CASE WHEN s > 0 THEN '##' ELSE '' END) || substr(token, s + 1, e - s) GROUP BY token, s),
step AS (SELECT token, 0 AS i, 0::BIGINT AS s, 0::BIGINT AS ends FROM {tokens}
  UNION ALL SELECT step.token, step.i + 1, step.ends, best.e FROM step JOIN best ON best.token = step.token AND best.s = step.ends),
done AS (SELECT token, max(ends) = length(token) AS ok FROM step GROUP BY token),
tp AS MATERIALIZED (SELECT step.token, step.i - 1 AS i,
    (CASE WHEN step.s > 0 THEN '##' ELSE '' END) || substr(step.token, step.s + 1, step.ends - step.s) AS piece
  FROM step JOIN done USING (token) WHERE ok AND step.i > 0
  UNION ALL SELECT token, 0, '[UNK]' FROM done WHERE NOT ok)"""


def _basic(text: str) -> str:
    cleaned = f"regexp_replace(regexp_replace({text}, '[\\t\\n\\r\\p{{Zs}}]', ' ', 'g'), '[\\p{{Cc}}\\p{{Cf}}\\x{{FFFD}}]', '', 'g')"
    low = f"strip_accents(lower({cleaned}))"
    spaced = f"regexp_replace({low}, '([!-/:-@\\[-`{{-~\\p{{P}}])', ' \\1 ', 'g')"
    return f"list_filter(string_split({spaced}, ' '), lambda w: w <> '')"


DICT = (
    VOCAB
    + f""",
dw AS (SELECT DISTINCT word FROM tok),
bt AS MATERIALIZED (SELECT word, unnest(t) AS token, unnest(range(len(t))) AS ord FROM (SELECT word, {_basic('word')} AS t FROM dw)),
dt AS (SELECT DISTINCT token FROM bt),
"""
    + _walk("dt")
    + """,
wp0 AS (SELECT bt.word, row_number() OVER (PARTITION BY bt.word ORDER BY bt.ord, tp.i) - 1 AS piece_idx, tp.piece,
  length(replace(tp.piece, '##', '')) AS len FROM bt JOIN tp USING (token)),
wp AS MATERIALIZED (SELECT word, piece_idx, wp0.piece, vocab.id, (piece_idx = 0)::INT AS is_start, len / length(word) AS weight,
  (row_number() OVER (PARTITION BY word ORDER BY len DESC, piece_idx) = 1)::INT AS focus FROM wp0 JOIN vocab ON vocab.piece = wp0.piece)"""
)

PIECES = (
    TAGGED
    + ",\n"
    + DICT
    + f""",
pieces AS (SELECT doc_id, sent_id, word_pos, split, t.word, {_id('gold')} AS label, piece_idx, piece, id, is_start, focus, weight
  FROM tagged t JOIN wp ON wp.word = t.word)"""
)


def _packed(sizes: str, limit: int, shard: str, table: str = "placed") -> str:
    """Greedy packing of ``sizes(shard, ord, n)`` (ord dense from 1 per shard)."""
    chunks = f"cast(ceil(n / {limit}.0) AS BIGINT)"
    fits = "fill + s.n <= {0}".format(limit)
    over = f"s.n > {limit}"
    return f"""walk AS (SELECT {shard}, ord, n,
    CASE WHEN n > {limit} THEN 1 ELSE 0 END::BIGINT AS pack_id, 0::BIGINT AS off, n > {limit} AS empty_before,
    CASE WHEN n > {limit} THEN 0 ELSE n END::BIGINT AS fill,
    CASE WHEN n > {limit} THEN 1 + {chunks} ELSE 0 END::BIGINT AS cur FROM {sizes} WHERE ord = 1
  UNION ALL SELECT s.{shard}, s.ord, s.n,
    CASE WHEN {over} THEN cur + 1 WHEN {fits} THEN cur ELSE cur + 1 END,
    CASE WHEN {over} THEN 0 WHEN {fits} THEN fill ELSE 0 END,
    {over} AND fill = 0,
    CASE WHEN {over} THEN 0 WHEN {fits} THEN fill + s.n ELSE s.n END,
    CASE WHEN {over} THEN cur + 1 + cast(ceil(s.n / {limit}.0) AS BIGINT) WHEN {fits} THEN cur ELSE cur + 1 END
  FROM walk JOIN {sizes} s ON s.{shard} = walk.{shard} AND s.ord = walk.ord + 1),
{table} AS (SELECT {shard}, ord, n, pack_id, off AS "offset", empty_before FROM walk)"""


def _packs(max_len: int) -> str:
    """Pieces placed in packs: ``pk(doc_id, pack_id, i, …)`` with i from 1, and ``pn``."""
    limit = max_len - 2
    return (
        PIECES
        + f""",
sz AS MATERIALIZED (SELECT doc_id, sent_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id) AS ord
  FROM (SELECT doc_id, sent_id, count(*) AS n FROM pieces GROUP BY 1, 2)),
"""
        + _packed("sz", limit, "doc_id")
        + f""",
ps AS (SELECT placed.doc_id, sz.sent_id, placed.pack_id, "offset", placed.n FROM placed JOIN sz ON sz.doc_id = placed.doc_id AND sz.ord = placed.ord),
pk AS MATERIALIZED (SELECT doc_id, CASE WHEN n > {limit} THEN pack_id + j // {limit} ELSE pack_id END AS pack_id,
    1 + CASE WHEN n > {limit} THEN j % {limit} ELSE "offset" + j END AS i, label, piece, id, is_start, focus, weight, sent_id, word_pos
  FROM (SELECT p.*, ps.pack_id, ps."offset", ps.n,
      row_number() OVER (PARTITION BY p.doc_id, p.sent_id ORDER BY word_pos, piece_idx) - 1 AS j
    FROM pieces p JOIN ps ON ps.doc_id = p.doc_id AND ps.sent_id = p.sent_id)),
keys AS (SELECT DISTINCT doc_id, pack_id FROM pk UNION SELECT doc_id, pack_id - 1 FROM placed WHERE empty_before),
pn AS (SELECT keys.doc_id, keys.pack_id, count(pk.i) AS n, coalesce(sum(is_start), 0) AS w FROM keys
  LEFT JOIN pk ON pk.doc_id = keys.doc_id AND pk.pack_id = keys.pack_id GROUP BY 1, 2)"""
    )


def _preds(max_len: int = 128) -> str:
    key = "(a.doc_id*31 + a.pack_id*17 + a.i*7)"
    return (
        _packs(max_len)
        + f""",
allpos AS (SELECT doc_id, pack_id, i, label, piece, is_start, focus FROM pk
  UNION ALL SELECT doc_id, pack_id, unnest(range(n + 1, {max_len})), 0, NULL, 0, 0 FROM pn
  UNION ALL SELECT doc_id, pack_id, 0, 0, '[CLS]', 1, 1 FROM pn),
pr AS MATERIALIZED (SELECT a.doc_id, a.pack_id, a.i, a.label, pn.n, pn.w,
  CASE WHEN a.i = pn.n + 1 THEN 1 ELSE is_start END AS is_start,
  CASE WHEN a.i = pn.n + 1 THEN 1 ELSE focus END AS focus,
  CASE WHEN a.i <= pn.n + 1 THEN 1 ELSE 0 END AS mask,
  CASE WHEN a.i = pn.n + 1 THEN '[SEP]' WHEN a.i > pn.n + 1 THEN '[PAD]' ELSE piece END AS piece,
  CASE WHEN {key} % 11 = 0 THEN 0 WHEN {key} % 13 = 0 THEN 5 ELSE label END AS logit
  FROM allpos a JOIN pn ON pn.doc_id = a.doc_id AND pn.pack_id = a.pack_id)"""
    )


def _score(source: str, seq: str | None, order: str, by: str = "") -> str:
    """Chunk metrics of ``source(…, gold, pred)`` rows; ``seq`` null: one stream."""
    part = f"PARTITION BY {seq} " if seq else ""
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""c0 AS (SELECT *, split_part(gold, '-', 1) AS gp, split_part(pred, '-', 1) AS pp,
  CASE WHEN contains(gold, '-') THEN substr(gold, instr(gold, '-') + 1) ELSE '' END AS gt,
  CASE WHEN contains(pred, '-') THEN substr(pred, instr(pred, '-') + 1) ELSE '' END AS pt FROM {source}),
c1 AS (SELECT *, coalesce(lag(gp) OVER w, 'O') AS lgp, coalesce(lag(gt) OVER w, '') AS lgt, coalesce(lag(pp) OVER w, 'O') AS lpp,
  coalesce(lag(pt) OVER w, '') AS lpt, lead(1) OVER w IS NULL AS fin FROM c0 WINDOW w AS ({part}ORDER BY {order})),
c2 AS (SELECT *,
  gp IN ('B','S','[',']') OR (lgp IN ('E','S','O') AND gp IN ('E','I')) OR (gp NOT IN ('O','.') AND lgt <> gt) AS sg,
  pp IN ('B','S','[',']') OR (lpp IN ('E','S','O') AND pp IN ('E','I')) OR (pp NOT IN ('O','.') AND lpt <> pt) AS sp,
  lgp IN ('E','S','[',']') OR (lgp IN ('B','I') AND gp IN ('B','S','O')) OR (lgp NOT IN ('O','.') AND lgt <> gt) AS eg,
  lpp IN ('E','S','[',']') OR (lpp IN ('B','I') AND pp IN ('B','S','O')) OR (lpp NOT IN ('O','.') AND lpt <> pt) AS ep FROM c1),
c3 AS (SELECT *, CASE WHEN sg AND sp AND gt = pt THEN 1 WHEN (eg AND ep AND lgt = lpt) OR eg <> ep OR gt <> pt THEN 0 END AS ev,
  eg AND ep AND lgt = lpt AS cl FROM c2),
c4 AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER ({part}ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ins FROM c3),
c5 AS (SELECT {lead}gt AS type, count(*) AS gold, 0 AS guessed, 0 AS correct FROM c4 WHERE sg GROUP BY ALL
  UNION ALL SELECT {lead}pt, 0, count(*), 0 FROM c4 WHERE sp GROUP BY ALL
  UNION ALL SELECT {lead}lgt, 0, 0, count(*) FROM c4 WHERE ins = 1 AND cl GROUP BY ALL
  UNION ALL SELECT {lead}gt, 0, 0, count(*) FROM c4 WHERE fin AND coalesce(ev, ins) = 1 GROUP BY ALL),
c6 AS (SELECT {lead}'type' AS level, type, sum(gold)::BIGINT AS gold, sum(guessed)::BIGINT AS guessed, sum(correct)::BIGINT AS correct,
    NULL::BIGINT AS tokens, NULL::BIGINT AS hits FROM c5 GROUP BY {lead}type
  UNION ALL SELECT {lead}'overall', '', sum(sg::INT)::BIGINT, sum(sp::INT)::BIGINT,
    sum((ins = 1 AND cl)::INT + (fin AND coalesce(ev, ins) = 1)::INT)::BIGINT, count(*), sum((gp = pp AND gt = pt)::INT)::BIGINT FROM c4 {group}),
c7 AS (SELECT *, CASE WHEN guessed = 0 THEN 0.0 ELSE correct::DOUBLE / guessed END AS p,
  CASE WHEN gold = 0 THEN 0.0 ELSE correct::DOUBLE / gold END AS r FROM c6),
metrics AS (SELECT {lead}level, type, gold, guessed, correct, tokens, p, r, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f,
  hits::DOUBLE / tokens AS a FROM c7)"""


def _out(by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return (
        f"SELECT {lead}level, type, gold, guessed, correct, tokens, round(p, 6) AS precision, round(r, 6) AS recall,"
        " round(f, 6) AS f1, round(a, 6) AS accuracy FROM metrics"
    )


def _with(ctes: str, select: str, recursive: bool = True) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{select}"


def _eval(pairs: str) -> str:
    return _with(_preds() + ",\n" + pairs + ",\n" + _score("sc", "doc_id, pack_id", "i"), _out())


SCORED = f"""em AS (SELECT doc_id, sent_id, word_pos, n, {', '.join(f'((doc_id*3 + sent_id*7 + word_pos*13 + {c * 29}) % 17) / 4.0::DOUBLE AS s{c}' for c in range(CLASSES))},
  (length(word) + word_pos) % {CLASSES} AS label_id, CASE WHEN word_pos % 4 = 3 THEN 0 ELSE 1 END AS mask
  FROM (SELECT tok.*, sent.n FROM tok JOIN sent USING (doc_id, sent_id)))"""
_CLS = range(CLASSES)
_TOP = "greatest(" + ", ".join(f"s{c}" for c in _CLS) + ")"
_LSE = f"({_TOP} + ln(" + " + ".join(f"exp(s{c} - {_TOP})" for c in _CLS) + "))"
_ARG = "CASE " + " ".join(f"WHEN s{c} = {_TOP} THEN {c}" for c in _CLS) + " END"


def _em(c: int) -> str:
    return f"((v.doc_id*3 + v.sent_id*7 + (v.pos + 1)*13 + {c * 29}) % 17) / 4.0::DOUBLE"


def _viterbi() -> str:
    first = ", ".join(f"((doc_id*3 + sent_id*7 + {c * 29}) % 17) / 4.0::DOUBLE AS s{c}, {c}::BIGINT AS c{c}" for c in _CLS)
    cols = []
    for j in _CLS:
        cand = [f"(v.s{i} + {TRANSITIONS[i][j]}::DOUBLE)" for i in _CLS]
        top = f"greatest({', '.join(cand)})"
        pick = "CASE " + " ".join(f"WHEN {cand[i]} = {top} THEN v.c{i}" for i in _CLS) + " END"
        cols.append(f"{top} + {_em(j)}, {pick} + (v.pos + 2) * {j}")
    best = "CASE " + " ".join(f"WHEN s{c} = {_TOP} THEN c{c}" for c in _CLS) + " END"
    return _with(
        LINES
        + f""",
v AS (SELECT doc_id, sent_id, n, 0::BIGINT AS pos, {first} FROM sent
  UNION ALL SELECT v.doc_id, v.sent_id, v.n, v.pos + 1, {', '.join(cols)} FROM v WHERE v.pos + 1 < v.n)""",
        f"SELECT doc_id, sent_id, n::INT AS n, {_TOP} AS score, {best} AS path_sum FROM v WHERE pos = n - 1",
    )


def _loglik(select: str) -> str:
    first = ", ".join(f"((doc_id*3 + sent_id*7 + {c * 29}) % 17) / 4.0::DOUBLE AS s{c}" for c in _CLS)

    def at(table: str, label: str) -> str:
        return f"CASE {label} " + " ".join(f"WHEN {c} THEN {table.format(c=c)}" for c in _CLS) + " END"

    tag0 = f"length(words[1]) % {CLASSES}"
    cur = f"(length(v.words[v.pos + 2]) + v.pos + 1) % {CLASSES}"
    prev = f"(length(v.words[v.pos + 1]) + v.pos) % {CLASSES}"
    cols = []
    for j in _CLS:
        cand = [f"(v.s{i} + {TRANSITIONS[i][j]}::DOUBLE)" for i in _CLS]
        top = f"greatest({', '.join(cand)})"
        cols.append(f"{top} + ln({' + '.join(f'exp({c} - {top})' for c in cand)}) + {_em(j)}")
    start = at("((doc_id*3 + sent_id*7 + {c}*29) % 17) / 4.0::DOUBLE", tag0)
    step = f"((v.doc_id*3 + v.sent_id*7 + (v.pos + 1)*13 + ({cur})*29) % 17) / 4.0::DOUBLE"
    trans = f"((({prev})*5 + ({cur})*3) % 7) / 4.0::DOUBLE"
    return _with(
        LINES
        + f""",
v AS (SELECT doc_id, sent_id, n, words, 0::BIGINT AS pos, {start} AS path, {first} FROM sent
  UNION ALL SELECT v.doc_id, v.sent_id, v.n, v.words, v.pos + 1, v.path + {step} + {trans}, {', '.join(cols)} FROM v WHERE v.pos + 1 < v.n),
ll AS (SELECT doc_id, sent_id, path - {_LSE} AS ll FROM v WHERE pos = n - 1)""",
        select,
    )


def _linear(wrap: str) -> str:
    parts = []
    for c in _CLS:
        w = "[" + ", ".join(f"{x}::DOUBLE" for x in WEIGHTS[c]) + "]"
        score = f"list_sum(list_transform(range(1, 65), lambda d: embedding[d]::DOUBLE * ({w})[d])) + {BIAS[c]}"
        parts.append(f"SELECT vec_id, {c} AS class_id, round({wrap.format(score)}, 4) AS score FROM embeddings")
    return " UNION ALL ".join(parts)


_REPORT = """pp AS (SELECT *, 'precision: ' || format('{:6.2f}', 100 * p) || '%; recall: ' || format('{:6.2f}', 100 * r)
  || '%; FB1: ' || format('{:6.2f}', 100 * f) AS sc FROM metrics),
ls AS (SELECT level, type, 0 AS k, 'processed ' || tokens || ' tokens with ' || gold || ' phrases; found: ' || guessed
    || ' phrases; correct: ' || correct || '.' AS line FROM pp WHERE level = 'overall'
  UNION ALL SELECT level, type, 1, 'accuracy: ' || format('{:6.2f}', 100 * a) || '%; ' || sc FROM pp WHERE level = 'overall'
  UNION ALL SELECT level, type, 0, lpad(type, 17, ' ') || ': ' || sc || '  ' || guessed FROM pp WHERE level = 'type')"""

_RUNS = (
    TAGGED
    + """,
runs AS (SELECT (100 * (g.r + 1))::INT AS step, doc_id, sent_id, word_pos, gold,
  CASE WHEN k % (12 + g.r) = 0 THEN 'O' WHEN k % 13 = 0 THEN 'S-Gene' ELSE gold END AS pred
  FROM tagged, range(10) g(r)),
"""
    + _score("runs", "step, doc_id, sent_id", "word_pos", "step")
)

_HIST = f"""hist AS (SELECT n_pieces, count(*) AS n_words FROM (SELECT count(*)::INT AS n_pieces FROM pieces WHERE split = 'train'
  GROUP BY doc_id, sent_id, word_pos) GROUP BY 1)"""

_DICT_OF_TRAIN = """fs AS (SELECT gold AS label, min({'d': doc_id, 's': sent_id, 'p': word_pos}) AS seen FROM tagged WHERE split = 'train' AND gold <> 'O' GROUP BY 1),
ld AS (SELECT 'O' AS label, 0 AS id UNION ALL SELECT label, (row_number() OVER (ORDER BY seen))::INT FROM fs
  UNION ALL SELECT 'X', (count(*) + 1)::INT FROM fs)"""

_CTX_ROWS = ", ".join(
    " + ".join(
        f"{i + 1} * coalesce(" + (f"lag(l, {-d}) OVER w" if d < 0 else f"lead(l, {d}) OVER w" if d else "l") + ", 0)"
        for i, d in enumerate(range(-((k - 1) // 2), k // 2 + 1))
    )
    + f" AS x{k}"
    for k in (1, 3, 5, 7, 2)
)

_COLS = "list_filter(regexp_split_to_array(value, '[\\t\\n\\v\\f\\r\\x1C-\\x1F\\x{85}\\p{Z}]+'), lambda w: w <> '')"
_DLINES = f"dl AS (SELECT doc_id, sent_id AS line_no, line AS value FROM ln), dc AS (SELECT *, len({_COLS}) AS n_cols FROM dl)"

_SEQ_EMB = """vr AS (SELECT doc_id, id % (SELECT count(*) FROM embeddings) AS vec_id, word_pos % (SELECT count(*) FROM embeddings) AS pos_id, is_start FROM pieces)"""

_WM = """cells AS (SELECT doc_id, pack_id, 0 AS word_idx, 0 AS piece_pos, 1.0::DOUBLE AS w FROM pn
  UNION ALL SELECT * FROM (SELECT doc_id, pack_id, (sum(is_start) OVER (PARTITION BY doc_id, pack_id ORDER BY i)) AS word_idx, i, weight FROM pk) WHERE word_idx > 0)"""

_WM_OUT = """SELECT doc_id, pack_id, count(*) AS n, sum(word_idx * piece_pos)::BIGINT AS place, round(sum(w), 8) AS w FROM cells GROUP BY 1, 2"""

# Rows of the matrix as the sequential rule forms them: a piece of weight 1 that
# opens a row closes it at once, otherwise the row runs to the next word start.
_WM_PARITY = """m0 AS (SELECT *, sum(is_start) OVER (PARTITION BY doc_id, pack_id ORDER BY i) AS wno FROM pk),
m1 AS (SELECT *, is_start = 1 OR coalesce(bool_and(weight = 1.0) OVER (PARTITION BY doc_id, pack_id, wno ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS opens FROM m0),
m2 AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id, pack_id ORDER BY i) AS word_idx FROM m1),
m3 AS (SELECT *, max(word_idx) OVER (PARTITION BY doc_id, pack_id) AS last_idx,
    bool_or(opens AND weight = 1.0) OVER (PARTITION BY doc_id, pack_id, word_idx) AS whole FROM m2),
cells AS (SELECT doc_id, pack_id, 0 AS word_idx, 0 AS piece_pos, 1.0::DOUBLE AS w FROM pn
  UNION ALL SELECT doc_id, pack_id, word_idx, i, weight FROM m3 WHERE word_idx < last_idx OR whole)"""

_POOL = (
    _WM
    + """,
pe AS (SELECT doc_id, pack_id, i AS piece_pos, unnest(range(5)) AS class_id FROM pk),
pooled AS (SELECT c.doc_id, c.pack_id, c.word_idx, e.class_id,
  sum(c.w * (((c.doc_id*3 + c.pack_id*7 + (c.piece_pos - 1)*13 + e.class_id*29) % 17) / 4.0::DOUBLE)) AS score
  FROM cells c JOIN pe e ON e.doc_id = c.doc_id AND e.pack_id = c.pack_id AND e.piece_pos = c.piece_pos GROUP BY ALL)"""
)


def _records(select: str) -> str:
    return _with(
        LINES
        + """,
rec AS (SELECT doc_id, sent_id, n, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'devel' ELSE 'test' END AS split FROM sent)""",
        select,
        False,
    )


def _budget(mode: str) -> str:
    cap = 8000 if mode == "combine" else 30000
    every = (
        "CASE WHEN steps >= 5000 THEN 1000 WHEN steps < 2000 THEN 300 ELSE 500 END"
        if mode == "combine"
        else "CASE WHEN steps < 5000 THEN 500 WHEN steps <= 10000 THEN 1000 ELSE 2000 END"
    )
    return f"""SELECT records, steps, {every} AS save_steps, '{mode}' AS mode FROM (SELECT count(*) AS records,
      least(floor(count(*) / 16 * 10)::BIGINT, {cap}) AS steps FROM rec WHERE split <> 'test')"""


def oracle_sql() -> dict[str, str]:
    clean = "regexp_replace(regexp_replace(html, '[\\t\\n\\r\\p{Zs}]', ' ', 'g'), '[\\p{Cc}\\p{Cf}\\x{FFFD}]', '', 'g')"
    cjk = "regexp_replace(translate(html, 'éñü', '中豈㐀'), '([\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{F900}-\\x{FAFF}])', ' \\1 ', 'g')"
    punct = "regexp_replace(html, '([!-/:-@\\[-`{-~\\p{P}])', ' \\1 ', 'g')"
    space = "list_filter(regexp_split_to_array({0}, '[\\t\\n\\v\\f\\r\\x1C-\\x1F\\x{{85}}\\p{{Z}}]+'), lambda w: w <> '')"
    collapsed = "trim(regexp_replace(text, '[\\t\\n\\v\\f\\r\\x1C-\\x1F\\x{85}\\p{Z}]+', ' ', 'g'))"
    hist = PIECES + ",\n" + _HIST
    q: dict[str, str] = {}

    q["clean_text"] = f"SELECT page_id, md5({clean}) AS digest FROM pages"
    q["cjk_space"] = f"SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, {cjk} AS t FROM pages)"
    q["punct_split"] = f"SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, {punct} AS t FROM pages)"
    q["whitespace_tokens"] = (
        f"SELECT page_id, len(w) AS n, md5(array_to_string(w, '|')) AS digest FROM (SELECT page_id, {space.format('html')} AS w FROM pages)"
    )
    q["strip_accents"] = "SELECT conv_id, turn, md5(strip_accents(lower(text))) AS digest FROM conversations"
    q["basic_tokenize"] = (
        f"SELECT conv_id, turn, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT conv_id, turn, {_basic('text')} AS t FROM conversations)"
    )
    q["basic_tokenize_words"] = _with(
        LINES, f"SELECT word, array_to_string({_basic('word')}, ' ') AS tokens FROM (SELECT DISTINCT word FROM tok)", False
    )
    q["normalize_text"] = (
        f"SELECT conv_id, turn, md5(lower(strip_accents(replace(replace({collapsed}, '``', '\"'), '''''', '\"')))) AS digest FROM conversations"
    )
    q["number_comma_split"] = """SELECT doc_id, len(p) AS n, md5(array_to_string(p, '|')) AS digest FROM (SELECT doc_id,
      flatten(list_transform(list_concat(['▁' || n_chars || ','], string_split(text, ' ')), lambda x:
        CASE WHEN regexp_matches(x, '\\p{Nd},$') THEN [(CASE WHEN starts_with(x, '▁') THEN '▁' ELSE '' END) || replace(x[:-2], '▁', ''), ','] ELSE [x] END)) AS p
      FROM documents)"""

    q["wordpiece"] = _with(
        LINES + ",\n" + VOCAB + ",\ndt AS (SELECT w AS token FROM low),\n" + _walk("dt"),
        "SELECT token, string_agg(piece, ' ' ORDER BY i) AS pieces FROM tp GROUP BY token",
    )
    q["vocabulary"] = _with(LINES + ",\n" + VOCAB, "SELECT piece, id FROM vocab", False)
    q["vocab_from_file"] = q["vocabulary"]
    q["tokenize_sentences"] = _with(
        PIECES,
        "SELECT doc_id, sent_id, count(*) AS n_pieces, sum((word_pos + 1) * id * (piece_idx + 1))::BIGINT AS checksum FROM pieces GROUP BY 1, 2",
    )
    q["tokenize_unseen"] = _with(
        PIECES,
        "SELECT doc_id, sent_id, count(*) AS n_pieces, sum((word_pos + 1) * id * (piece_idx + 1))::BIGINT AS checksum FROM pieces WHERE split <> 'train' GROUP BY 1, 2",
    )
    q["tokenize_letters"] = _with(
        LINES,
        """SELECT doc_id, sent_id, sum(length(word))::BIGINT AS n_pieces,
        sum((word_pos + 1) * list_sum([unicode(x)::BIGINT FOR x IN string_split(word, '')]))::BIGINT AS checksum FROM tok GROUP BY 1, 2""",
        False,
    )
    q["piece_ids"] = _with(PIECES, "SELECT piece, id, count(*) AS n FROM pieces GROUP BY 1, 2")
    q["stream_piece_ids"] = _with(
        PIECES,
        f"""SELECT piece, id, count(*) AS n FROM (SELECT unnest({_basic('text')}) AS piece FROM documents) t
        LEFT JOIN (SELECT DISTINCT piece, id FROM pieces) v USING (piece) GROUP BY 1, 2""",
    )
    q["ids_to_pieces"] = _with(PIECES, "SELECT id, piece, count(*) AS n FROM pieces GROUP BY 1, 2")

    q["parse_tag"] = _with(
        TAGGED,
        """SELECT regexp_extract(pred, '^([^-]*)', 1) AS prefix, CASE WHEN contains(pred, '-') THEN regexp_extract(pred, '^[^-]*-(.*)$', 1) ELSE '' END AS type,
        count(*) AS n FROM tagged GROUP BY 1, 2""",
        False,
    )
    q["label_dict"] = _with(TAGGED + ",\n" + _DICT_OF_TRAIN, "SELECT label, id FROM ld", False)
    q["class_count"] = _with(TAGGED + ",\n" + _DICT_OF_TRAIN, "SELECT count(*) - 1 AS classes FROM ld", False)
    q["label_map_file"] = q["label_dict"]
    q["label_encode"] = _with(
        TAGGED + ",\n" + _DICT_OF_TRAIN,
        "SELECT coalesce(id, 0)::INT AS label_id, count(*) AS n, sum(word_pos)::BIGINT AS pos_sum FROM tagged LEFT JOIN ld ON ld.label = pred GROUP BY 1",
        False,
    )
    q["label_decode"] = _with(
        PIECES,
        f"""SELECT {_name('p.label')} AS label, {_name('CASE WHEN is_start = 1 THEN p.label ELSE 9 END')} AS label_x, count(*) AS n,
        sum(piece_idx)::BIGINT AS idx_sum FROM pieces p GROUP BY 1, 2""",
    )
    q["first_seen_words"] = _with(
        TAGGED,
        "SELECT word, s.d AS doc_id, s.s AS sent_id, s.p::INT AS pos FROM (SELECT word, min({'d': doc_id, 's': sent_id, 'p': word_pos}) AS s FROM tagged GROUP BY 1)",
        False,
    )
    q["align_first_piece"] = _with(
        PIECES,
        """SELECT doc_id, sent_id, count(*) AS n, sum(is_start)::BIGINT AS starts, sum(label * (word_pos + 1))::BIGINT AS label_sum,
        sum((CASE WHEN is_start = 1 THEN label ELSE 9 END) * (word_pos + 1) * (piece_idx + 1))::BIGINT AS label_x_sum FROM pieces GROUP BY 1, 2""",
    )
    q["piece_weights"] = _with(PIECES, "SELECT piece, count(*) AS n, round(sum(weight), 8) AS weight FROM pieces GROUP BY 1")
    q["focus_piece"] = _with(
        PIECES,
        """SELECT doc_id, sent_id, sum(focus)::BIGINT AS n_focus, sum(focus * (piece_idx + 1) * (word_pos + 1))::BIGINT AS focus_at,
        sum((CASE WHEN focus = 1 THEN label ELSE 9 END) * (piece_idx + 1))::BIGINT AS label_sum FROM pieces GROUP BY 1, 2""",
    )
    q["pieces_per_word_hist"] = _with(hist, "SELECT n_pieces, n_words FROM hist")
    q["histogram_file"] = q["pieces_per_word_hist"]
    q["top4_widths"] = _with(
        PIECES
        + """,
wd AS (SELECT doc_id, sent_id, word_pos, count(*)::INT AS n_pieces FROM pieces WHERE split = 'train' GROUP BY 1, 2, 3),
hs AS (SELECT n_pieces, count(*) AS n_words, min({'d': doc_id, 's': sent_id, 'p': word_pos}) AS seen FROM wd GROUP BY 1)""",
        "SELECT (row_number() OVER (ORDER BY n_words DESC, seen))::INT AS rank, n_pieces AS width FROM hs QUALIFY rank <= 4",
    )
    q["histogram_json"] = _with(
        hist, """SELECT '{' || string_agg('"' || n_pieces || '":' || n_words, ',' ORDER BY n_pieces) || '}' AS value FROM hist"""
    )

    q["tokens_from_docs"] = _with(
        TAGGED,
        "SELECT gold AS label, count(*) AS n, sum(word_pos)::BIGINT AS pos_sum, sum(length(word))::BIGINT AS chars FROM tagged GROUP BY 1",
        False,
    )
    q["sentence_sizes"] = _with(LINES, "SELECT n AS n_words, count(*) AS n_sentences FROM sent GROUP BY 1", False)
    q["format_violations"] = _with(
        LINES + ", " + _DLINES,
        """SELECT doc_id, line_no::INT AS line_no, n_cols::INT AS n_cols, expected::INT AS expected FROM (SELECT *, first_value(n_cols) OVER (PARTITION BY doc_id ORDER BY line_no) AS expected
        FROM dc WHERE n_cols > 0) WHERE n_cols < 3 OR n_cols <> expected""",
        False,
    )
    q["malformed_rows"] = _with(
        LINES + ", " + _DLINES,
        "SELECT doc_id, count(*) AS n FROM dc WHERE n_cols > 0 AND NOT contains(value, '|') GROUP BY 1",
        False,
    )
    q["real_tokens"] = _with(
        TAGGED, "SELECT word AS token, count(*) AS n FROM tagged WHERE split = 'test' AND length(word) <> 7 GROUP BY 1", False
    )

    sizes = LINES + ",\nsz AS (SELECT doc_id, sent_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id) AS ord FROM sent),\n"
    back = 'FROM placed JOIN sz ON sz.doc_id = placed.doc_id AND sz.ord = placed.ord'
    q["pack_combine"] = _with(
        sizes + _packed("sz", 30, "doc_id"),
        f'SELECT sz.doc_id, sz.sent_id, sz.n, pack_id, "offset"::INT AS "offset", empty_before {back}',
    )
    q["oversize_chunks"] = _with(
        sizes + _packed("sz", 30, "doc_id"),
        f"""SELECT doc_id, sent_id, c::INT AS chunk, pack_id + c AS pack_id, (c * 30)::INT AS "first", least(30, n - c * 30) AS size FROM (
        SELECT sz.doc_id, sz.sent_id, sz.n, pack_id, unnest(range(cast(ceil(sz.n / 30.0) AS BIGINT))) AS c {back} WHERE sz.n > 30)""",
    )
    stream = (
        LINES
        + """,
sz AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY doc_id, sent_id) AS ord, n FROM (SELECT *,
  CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'devel' ELSE 'test' END AS split FROM sent)),
"""
        + _packed("sz", 510, "split")
    )
    q["pack_stream"] = _with(
        stream, 'SELECT split, ord - 1 AS idx, n, pack_id, "offset"::INT AS "offset", empty_before FROM placed'
    )
    q["pack_simple"] = _with(
        PIECES,
        """SELECT doc_id, sent_id AS pack_id, (3 + sum(CASE WHEN j <= 126 THEN id * (j + 1) ELSE 0 END) + 4 * (least(count(*), 126) + 2))::BIGINT AS input_ids,
        ((least(count(*), 126) + 2) * (least(count(*), 126) + 3) / 2)::BIGINT AS input_mask,
        sum(CASE WHEN is_start = 1 AND w <= 126 THEN label * (w + 1) ELSE 0 END)::BIGINT AS words_label
        FROM (SELECT *, row_number() OVER o AS j, sum(is_start) OVER o AS w FROM pieces WINDOW o AS (PARTITION BY doc_id, sent_id ORDER BY word_pos, piece_idx))
        GROUP BY 1, 2""",
    )
    q["padded_features"] = _with(
        _packs(512),
        """SELECT pn.doc_id, pn.pack_id,
        (3 + coalesce(sum(id * (i + 1)), 0) + 4 * (n + 2))::BIGINT AS input_ids,
        ((n + 2) * (n + 3) / 2)::BIGINT AS input_mask, 0::BIGINT AS segment_ids,
        coalesce(sum(label * (i + 1)), 0)::BIGINT AS label_ids,
        (1 + coalesce(sum(is_start * (i + 1)), 0) + n + 2)::BIGINT AS is_start_label,
        coalesce(sum(CASE WHEN is_start = 1 THEN label * (wno + 1) END), 0)::BIGINT AS words_label,
        coalesce(sum((CASE WHEN is_start = 1 THEN label ELSE 9 END) * (i + 1)), 0)::BIGINT AS label_x,
        coalesce(sum((CASE WHEN focus = 1 THEN label ELSE 9 END) * (i + 1)), 0)::BIGINT AS is_weight_focus,
        (1 + coalesce(sum(is_start * (i + 1)), 0) + n + 2)::BIGINT AS label_x_mask,
        (1 + coalesce(sum(focus * (i + 1)), 0) + n + 2)::BIGINT AS weight_focus_mask,
        ((w + 2) * (w + 3) / 2)::BIGINT AS weight_matrix_mask,
        md5('[CLS] ' || coalesce(string_agg(piece, ' ' ORDER BY i) || ' ', '') || '[SEP]' || repeat(' [PAD]', (510 - n)::INT)) AS piece_list
        FROM pn LEFT JOIN (SELECT *, sum(is_start) OVER (PARTITION BY doc_id, pack_id ORDER BY i) AS wno FROM pk) k
        ON k.doc_id = pn.doc_id AND k.pack_id = pn.pack_id GROUP BY pn.doc_id, pn.pack_id, n, w""",
    )
    q["weight_matrix"] = _with(_packs(128) + ",\n" + _WM, _WM_OUT)
    q["weight_matrix_parity"] = _with(_packs(128) + ",\n" + _WM_PARITY, _WM_OUT)
    fields = ", ".join(f"('{name}')" for name in ARRAYS)
    q["feature_violations"] = _with(
        _packs(128), f"SELECT f.field, 128 AS size, count(*) AS n FROM pn, (VALUES {fields}) f(field) GROUP BY 1"
    )
    q["dense_matrix"] = _with(
        _packs(128) + ",\n" + _WM,
        """SELECT doc_id, pack_id, 16384 AS n, round(sum(w::FLOAT::DOUBLE), 3) AS total,
        round(sum(w::FLOAT::DOUBLE * ((word_idx * 128 + piece_pos) % 97 + 1)), 3) AS marked FROM cells GROUP BY 1, 2""",
    )
    padded = """md5('[CLS] ' || coalesce(string_agg(piece, ' ' ORDER BY i) || ' ', '') || '[SEP]' || repeat(' [PAD]', (126 - n)::INT)) AS piece_list"""
    held = "FROM pn LEFT JOIN pk k ON k.doc_id = pn.doc_id AND k.pack_id = pn.pack_id"
    q["read_features"] = _with(
        _packs(128),
        f"""SELECT pn.doc_id, pn.pack_id, (3 + coalesce(sum(id * (i + 1)), 0) + 4 * (n + 2))::BIGINT AS input_ids,
        (1 + coalesce(sum(is_start * (i + 1)), 0) + n + 2)::BIGINT AS is_start_label, {padded}
        {held} WHERE pn.doc_id % 10 = 9 GROUP BY pn.doc_id, pn.pack_id, n""",
    )
    q["preview"] = _with(
        _packs(128),
        f"""SELECT pn.doc_id, pn.pack_id, {padded}, coalesce(sum(label * (i + 1)), 0)::BIGINT AS label_ids {held}
        GROUP BY pn.doc_id, pn.pack_id, n ORDER BY pn.doc_id, pn.pack_id LIMIT 1""",
    )
    q["length_violations"] = _with(
        LINES,
        """SELECT f.field, n::INT AS size, count(*) AS n FROM sent, (VALUES ('words'), ('gold'), ('pred')) f(field)
        WHERE sent.n <> 12 GROUP BY f.field, sent.n""",
        False,
    )
    q["feature_store"] = _with(
        _packs(128),
        """SELECT pn.doc_id, pn.pack_id, (3 + coalesce(sum(id * (i + 1)), 0) + 4 * (n + 2))::BIGINT AS input_ids,
        coalesce(sum((CASE WHEN is_start = 1 THEN label ELSE 9 END) * (i + 1)), 0)::BIGINT AS label_x
        FROM pn LEFT JOIN pk k ON k.doc_id = pn.doc_id AND k.pack_id = pn.pack_id WHERE pn.doc_id % 10 = 8 GROUP BY pn.doc_id, pn.pack_id, n""",
    )
    q["sequence_sizes"] = _with(_packs(128), "SELECT doc_id, pack_id, (w + 2)::INT AS words, (n + 2)::INT AS pieces FROM pn")

    weighted = "list_sum(list_transform(range(1, 65), lambda d: {0} * d))"
    q["embedding_gather"] = _with(
        PIECES + ",\n" + _SEQ_EMB,
        f"""SELECT doc_id, count(*) AS n, round(sum({weighted.format('embedding[d]::DOUBLE')}), 3) AS total
        FROM vr JOIN embeddings e ON e.vec_id = vr.vec_id GROUP BY 1""",
    )
    q["embedding_sum"] = _with(
        PIECES + ",\n" + _SEQ_EMB,
        f"""SELECT doc_id, count(*) AS n, round(sum({weighted.format('(e.embedding[d]::DOUBLE + t.embedding[d]::DOUBLE + p.embedding[d]::DOUBLE)')}), 3) AS total
        FROM vr JOIN embeddings e ON e.vec_id = vr.vec_id JOIN embeddings t ON t.vec_id = vr.is_start
        JOIN embeddings p ON p.vec_id = vr.pos_id GROUP BY 1""",
    )
    q["linear_scores"] = _linear("{0}")
    q["linear_tanh"] = _linear("tanh({0})")
    q["word_pool"] = _with(
        _packs(128) + ",\n" + _POOL,
        "SELECT doc_id, class_id::INT AS class_id, count(*) AS n, round(sum(score), 8) AS score FROM pooled GROUP BY 1, 2",
    )
    q["pooled_labels"] = _with(
        _packs(128)
        + ",\n"
        + _POOL
        + f""",
pv AS (SELECT doc_id, pack_id, word_idx, {', '.join(f'round(max(score) FILTER (class_id = {c}), 6) AS s{c}' for c in _CLS)} FROM pooled GROUP BY 1, 2, 3)""",
        f"SELECT ({_ARG})::INT AS pred, count(*) AS n, round(sum(exp({_TOP} - {_LSE})), 2) AS prob FROM pv GROUP BY 1",
    )
    q["softmax_argmax"] = _with(
        LINES + ",\n" + SCORED,
        f"SELECT ({_ARG})::INT AS pred, count(*) AS n, round(sum(exp(s0 - {_LSE})), 3) AS p0 FROM em GROUP BY 1",
        False,
    )
    own = "CASE label_id " + " ".join(f"WHEN {c} THEN s{c}" for c in _CLS) + " END"
    q["masked_loss"] = _with(
        LINES + ",\n" + SCORED,
        f"SELECT round(sum(mask * ({_LSE} - ({own}))), 4) AS total_loss, round(avg({_LSE} - ({own})), 4) AS mean_loss FROM em",
        False,
    )
    q["one_hot"] = _with(
        LINES + ",\n" + SCORED, "SELECT label_id::INT AS class_id, count(*) AS n FROM em GROUP BY 1", False
    )
    q["viterbi"] = _viterbi()
    q["seq_loglik"] = _loglik("SELECT doc_id, sent_id, round(ll, 4) AS log_likelihood FROM ll")
    q["viterbi_long"] = q["viterbi"]
    q["seq_loglik_long"] = q["seq_loglik"]
    q["mean_loglik"] = _loglik("SELECT round(avg(-ll), 4) AS loss FROM ll")

    def spans(place: str, within: str) -> str:
        apart = f"PARTITION BY {within}" if within else ""
        keys = f"{within}, " if within else ""
        return _with(
            TAGGED
            + f""",
g0 AS (SELECT doc_id, sent_id, {place} AS k, split_part(gold, '-', 1) AS gp, CASE WHEN contains(gold, '-') THEN substr(gold, instr(gold, '-') + 1) ELSE '' END AS gt FROM tagged),
g1 AS (SELECT *, coalesce(lag(gp) OVER w, 'O') AS lp, coalesce(lag(gt) OVER w, '') AS lt FROM g0 WINDOW w AS ({apart} ORDER BY k)),
g2 AS (SELECT *, gp IN ('B','S','[',']') OR (lp IN ('E','S','O') AND gp IN ('E','I')) OR (gp NOT IN ('O','.') AND lt <> gt) AS s FROM g1),
g3 AS (SELECT *, sum(s::INT) OVER ({apart} ORDER BY k) AS grp FROM g2 WHERE gp <> 'O')""",
            f'SELECT {keys}min(k) AS "start", max(k) AS "end", min(gt) AS type FROM g3 GROUP BY {keys}grp',
            False,
        )

    q["chunk_spans"] = spans("word_pos::INT", "doc_id, sent_id")
    q["chunk_spans_long"] = spans("((doc_id * 65536 + sent_id) * 65536 + word_pos)::BIGINT", "")
    seq = _score("tagged", "doc_id, sent_id", "word_pos")
    q["conll_score"] = _with(TAGGED + ",\n" + seq, _out(), False)
    q["conll_file_score"] = q["conll_score"]
    q["conll_score_long"] = q["conll_score"]
    q["conll_score_stream"] = _with(TAGGED + ",\n" + _score("tagged", None, "doc_id, sent_id, word_pos"), _out(), False)
    q["score_report"] = _with(
        TAGGED + ",\n" + seq + ",\n" + _REPORT,
        "SELECT (row_number() OVER (ORDER BY level, type, k))::INT AS line_no, line FROM ls",
        False,
    )
    q["score_by_run"] = _with(_RUNS, _out("step"), False)
    q["run_select"] = _with(
        _RUNS, "SELECT step, 1000::INT AS max_steps, round(f, 6) AS f1 FROM metrics WHERE level = 'overall' AND step > 200", False
    )
    q["last_run"] = _with(
        _RUNS, "SELECT step, 1000::INT AS max_steps, round(f, 6) AS f1 FROM metrics WHERE level = 'overall' AND step = 1000", False
    )
    q["run_metrics"] = _with(
        _RUNS, "SELECT step, 'f1' AS key, round(f, 6) AS value FROM metrics WHERE level = 'overall'", False
    )

    voted = f"""f1 AS (SELECT *, sum(is_start) OVER (PARTITION BY doc_id, pack_id ORDER BY i) AS wno FROM pr WHERE i > 0 AND mask = 1 AND piece <> '[SEP]'),
f2 AS (SELECT doc_id, pack_id, wno, logit, count(*) AS n, min(i) AS seen FROM f1 GROUP BY 1, 2, 3, 4),
f3 AS (SELECT doc_id, pack_id, wno, logit FROM f2 QUALIFY row_number() OVER (PARTITION BY doc_id, pack_id, wno ORDER BY n DESC, seen) = 1),
f4 AS (SELECT doc_id, pack_id, wno, arg_min(label, i) AS label, min(i) AS i FROM f1 GROUP BY 1, 2, 3),
sc AS (SELECT f4.doc_id, f4.pack_id, f4.i, {_name('f4.label')} AS gold, {_name('f3.logit')} AS pred FROM f4
  JOIN f3 ON f3.doc_id = f4.doc_id AND f3.pack_id = f4.pack_id AND f3.wno = f4.wno)"""
    label_x = "CASE WHEN i = 0 OR i > n THEN 0 WHEN is_start = 1 THEN label ELSE 9 END"
    focus = "CASE WHEN i = 0 OR i > n THEN 0 WHEN focus = 1 THEN label ELSE 9 END"
    first_x = f"sc AS (SELECT doc_id, pack_id, i, {_name(label_x)} AS gold, {_name('logit')} AS pred FROM pr WHERE i BETWEEN 1 AND n AND is_start = 1)"
    q["vote_words"] = _eval(voted)
    by_word = f"""f1 AS (SELECT doc_id, sent_id, word_pos, piece_idx, label, (doc_id*31 + sent_id*17 + word_pos*7 + piece_idx // 2) % 5 AS logit FROM pieces),
f2 AS (SELECT doc_id, sent_id, word_pos, logit, count(*) AS n, min(piece_idx) AS seen, min(label) AS label FROM f1 GROUP BY 1, 2, 3, 4),
sc AS (SELECT doc_id, sent_id, word_pos, {_name('label')} AS gold, {_name('logit')} AS pred FROM f2
  QUALIFY row_number() OVER (PARTITION BY doc_id, sent_id, word_pos ORDER BY n DESC, seen) = 1)"""
    q["vote_source_words"] = _with(
        PIECES + ",\n" + by_word + ",\n" + _score("sc", "doc_id, sent_id", "word_pos"), _out()
    )
    in_packs = f"""f1 AS (SELECT doc_id, sent_id, word_pos, pack_id * 1000 + i AS place, label, CASE WHEN (doc_id*31 + pack_id*17 + i*7) % 11 = 0 THEN 0
  WHEN (doc_id*31 + pack_id*17 + i*7) % 13 = 0 THEN 5 ELSE label END AS logit FROM pk),
f2 AS (SELECT doc_id, sent_id, word_pos, logit, count(*) AS n, min(place) AS seen, min(label) AS label FROM f1 GROUP BY 1, 2, 3, 4),
sc AS (SELECT doc_id, sent_id, word_pos, {_name('label')} AS gold, {_name('logit')} AS pred FROM f2
  QUALIFY row_number() OVER (PARTITION BY doc_id, sent_id, word_pos ORDER BY n DESC, seen) = 1)"""
    q["vote_packed_source_words"] = _with(
        _packs(128) + ",\n" + in_packs + ",\n" + _score("sc", "doc_id, sent_id", "word_pos"), _out()
    )
    q["eval_x"] = _eval(first_x)
    q["eval_focus"] = _eval(
        f"sc AS (SELECT doc_id, pack_id, i, {_name(focus)} AS gold, {_name('logit')} AS pred FROM pr WHERE i BETWEEN 1 AND n AND {focus} <> 9)"
    )
    q["eval_weight"] = _eval(
        f"sc AS (SELECT doc_id, pack_id, i, {_name('label')} AS gold, {_name('logit')} AS pred FROM pr WHERE i BETWEEN 1 AND w)"
    )
    q["eval_first_piece"] = _eval(
        f"sc AS (SELECT doc_id, pack_id, i, {_name('label')} AS gold, {_name('logit')} AS pred FROM pr WHERE i > 0 AND mask = 1 AND piece <> '[SEP]' AND is_start = 1)"
    )
    q["eval_stream"] = _with(_preds() + ",\n" + first_x + ",\n" + _score("sc", None, "doc_id, pack_id, i"), _out())
    q["predictions_file"] = _with(
        _preds(),
        f"""SELECT (SELECT count(*) FROM pn) AS n, sum(logit * (i + 1))::BIGINT AS logits, sum(mask * (i + 1))::BIGINT AS mask,
        sum(({label_x}) * (i + 1))::BIGINT AS label_x FROM pr""",
    )
    q["weighted_accuracy"] = _with(
        _preds(), "SELECT round(sum(mask * (label = logit)::INT)::DOUBLE / sum(mask), 6) AS accuracy FROM pr"
    )
    q["micro_f1"] = _with(
        _preds(),
        """SELECT tp, predicted, actual, round(2.0 * tp / (predicted + actual), 6) AS f1 FROM (SELECT sum(mask * (label < 8 AND label = logit)::INT)::BIGINT AS tp,
        sum(mask * (logit < 8)::INT)::BIGINT AS predicted, sum(mask * (label < 8)::INT)::BIGINT AS actual FROM pr)""",
    )
    q["inconsistent_words"] = _with(
        PIECES,
        """SELECT consistent, count(*) AS n FROM (SELECT count(DISTINCT (doc_id*31 + sent_id*17 + word_pos*7 + piece_idx // 2) % 5) = 1 AS consistent
        FROM pieces GROUP BY doc_id, sent_id, word_pos) GROUP BY 1""",
    )

    q["train_union"] = _records("SELECT split, count(*) AS records, sum(n)::BIGINT AS words FROM rec WHERE split <> 'test' GROUP BY 1")
    q["epoch_repeat"] = _records(
        "SELECT e::INT AS epoch, count(*) AS records, sum(n)::BIGINT AS words FROM rec, range(3) t(e) WHERE split = 'train' GROUP BY 1"
    )
    q["batch_assign"] = _records(
        """SELECT batch, count(*) AS records, min(doc_id) AS first_doc, sum(n)::BIGINT AS words FROM (SELECT *,
        (row_number() OVER (ORDER BY doc_id, sent_id) - 1) // 16 AS batch FROM rec) GROUP BY 1 HAVING count(*) = 16"""
    )
    q["step_budget"] = _records(_budget("combine") + " UNION ALL " + _budget("simple"))
    q["shuffled_records"] = _records(
        """SELECT split, doc_id, sent_id, n::INT AS n, row_number() OVER (ORDER BY
        ((doc_id * 48271 + sent_id * 69621 + 42) % 2147483647 * 16807) % 2147483647, doc_id, sent_id) - 1 AS place FROM rec"""
    )
    q["tagger_scores"] = _with(
        TAGGED,
        """SELECT CASE WHEN gold = 'O' THEN 0 WHEN starts_with(gold, 'S-') THEN 1 ELSE 2 END AS tag, count(*) AS n, true AS better
        FROM tagged WHERE split = 'devel' GROUP BY 1""",
        False,
    )
    q["utf8_text"] = "SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM documents"
    q["context_window_features"] = _with(
        LINES,
        f"""SELECT doc_id, {', '.join(f'sum(x{k})::BIGINT AS ctx_{k}' for k in (1, 3, 5, 7, 2))} FROM (SELECT doc_id, {_CTX_ROWS}
        FROM (SELECT *, length(word) AS l FROM tok) WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY word_pos)) GROUP BY 1""",
        False,
    )
    return q
