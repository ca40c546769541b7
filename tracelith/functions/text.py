"""Text assembly: value formats, budgeted prefixes, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fixed(c: Column, digits: int = 3, missing: str = "null") -> Column:
    return F.coalesce(F.format_string(f"%.{digits}f", c.cast("double")), F.lit(missing)) if digits else F.coalesce(c.cast("string"), F.lit(missing))


def token_count(c: Column) -> Column:
    """Words and marks; the default where no tokenizer is given."""
    return F.regexp_count(c, F.lit(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]"))


def budget_prefix(df: DataFrame, keys: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """Rows of each key up to the first that overflows the budget; the first row always stays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    run = df.withColumns({"used": F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_rn": F.row_number().over(w)})
    over = F.max(F.when((F.col("used") > budget) & (F.col("_rn") > 1), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return run.withColumn("_over", over).where("_over = 0").drop("_over", "_rn")


def prompt(role: str, lines: dict[str, list[tuple[str, Column]]], question: str) -> Column:
    """Role, grouped `- name: value` lines, question and the answer mark."""
    parts: list[Column] = [F.lit(role)]
    for title, items in lines.items():
        parts.append(F.lit(f"[{title}]"))
        parts += [F.concat(F.lit(f"- {n}: "), F.substring(v, 1, 500)) for n, v in items]
    return F.concat_ws("\n", *parts, F.lit(question), F.lit("Answer:"))


def scalar(c: Column, kind: str, digits: int = 3, missing: str = "null") -> Column:
    """A value as prompts have it: digits for doubles, true or false, one line of up to 500 characters for text."""
    if kind in ("double", "float"):
        v = c.cast("double")
        return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), F.format_string(f"%.{digits}f", v)).otherwise(F.lit(missing))
    if kind == "boolean":
        return F.when(c.isNull(), missing).when(c, "true").otherwise("false")
    if kind == "string":
        t = F.trim(F.replace(c, F.lit("\n"), F.lit(" ")))
        return F.when(c.isNull(), missing).otherwise(F.concat(F.substring(t, 1, 500), F.when(F.length(t) > 500, "...").otherwise("")))
    return F.coalesce(c.cast("string"), F.lit(missing))


def _scientific(v: Column) -> Column:
    """Two digits and an exponent of two digits at least."""
    return F.lower(F.format_string("%.2e", v))


def magnitude(c: Column, digits: int = 1) -> Column:
    """Fixed digits from 0.01 up to a million, else scientific; - for null."""
    v = c.cast("double")
    return F.when(v.isNull(), "-").when((F.abs(v) >= 0.01) & (F.abs(v) < 1e6), F.format_string(f"%.{digits}f", v)).otherwise(_scientific(v))


def pair(c: Column, digits: int = 1) -> Column:
    """[a,b] of an array of doubles; - if null or empty."""
    return F.when(c.isNull() | (F.size(c) == 0), "-").otherwise(F.concat(F.lit("["), F.array_join(F.transform(c, lambda v: magnitude(v, digits)), ","), F.lit("]")))


def signal(c: Column) -> Column:
    """Signal strength: two significant digits, 0 as it is, - for null."""
    v = c.cast("double")
    return F.when(v.isNull(), "-").when(v == 0, "0").when((F.abs(v) >= 0.01) & (F.abs(v) < 1000), F.format_string("%.2f", v)).otherwise(_scientific(v))


#: Titles of feature groups by what a name begins with, and of sender-history subgroups by what it contains; the first wins.
GROUPS = (("msg_catch_", "Checks"), ("ctx_recentk_hist_", "Sender history: extent"), ("ctx_recentk_", "Sender history"), ("ctx_", "Neighbours"))
HISTORY_GROUPS = (("mgtsv", "position and speed"), ("int_min_neighbor", "overlap"), ("triplet_ratio", "similar neighbours"), ("speed_diff_mean", "speed gap"), ("head_diff_mean_deg", "heading gap"))
OTHER_GROUP = "Timing"


def feature_group(name: str) -> str:
    """Title under which a feature is listed."""
    title = next((t for prefix, t in GROUPS if name.startswith(prefix)), OTHER_GROUP)
    if title == "Sender history":
        title += next((f": {t}" for mark, t in HISTORY_GROUPS if mark in name), "")
    return title


def feature_name(name: str, style: str = "raw", aliases: dict[str, str] | None = None) -> str:
    """The column's name, or (descriptive) its alias or the name in words."""
    if style not in ("raw", "descriptive"):
        raise ValueError(f"feature name style {style!r} is neither raw nor descriptive")
    return name if style == "raw" else (aliases or {}).get(name, name.replace("_", " "))


def select_features(columns: list[str], include: list[str], prefixes: list[str], exclude: list[str], default: list[str]) -> list[str]:
    """Listed columns in their order (default if none are listed), then those with a prefix by name, without excluded ones."""
    listed = list(dict.fromkeys(c for c in include or default if c in columns and c not in exclude))
    return listed + sorted(c for c in columns if c not in listed and c not in exclude and any(c.startswith(p) for p in prefixes))


#: Prompt variants: what they open with, and hints under group titles. The texts are this package's own.
VARIANTS: dict[str, tuple[tuple[str, ...], dict[str, str]]] = {
    "default": (("You check messages that vehicles broadcast.", "Decide whether the message below is an attack."), {}),
    "traffic_neutral": (("You check messages that vehicles broadcast.", "Dense and slow traffic alone is no sign of an attack."), {"Neighbours": "Close neighbours are usual in dense traffic."}),
    "traffic_neutral_recentk": (("You check messages that vehicles broadcast.", "Weigh the sender's recent messages; dense traffic alone is no sign."), {"Neighbours": "Close neighbours are usual in dense traffic.", "Sender history": "Look for checks that failed again and again."}),
    "replay_neutral_recentk": (("You check messages that vehicles broadcast.", "Old data sent again looks plausible by itself; compare it with the sender's recent messages."), {"Sender history": "Repeated gaps between claim and motion count."}),
    "dosdisruptive_classic_recentk": (("You check messages that vehicles broadcast.", "Floods of messages with random content disrupt; the sender's rate and recent checks tell."), {"Timing": "Beacons come about once a second.", "Sender history": "Erratic checks count."}),
    "traffic_benign_prior": (("You check messages that vehicles broadcast.", "Most messages are benign; call an attack only on clear evidence."), {}),
    "traffic_compact": (("Is this vehicle message an attack?",), {}),
}


def message_prompt(columns: dict[str, str], variant: str = "default", style: str = "raw", aliases: dict[str, str] | None = None) -> Column:
    """Opening lines, features (name to type) under group titles with hints, and the answer mark."""
    if variant not in VARIANTS:
        raise ValueError(f"prompt variant {variant!r} is none of {', '.join(VARIANTS)}")
    opening, hints = VARIANTS[variant]
    parts: list[Column] = [F.lit(x) for x in opening]
    titles = dict.fromkeys(feature_group(c) for c in columns)
    for title in titles:
        parts.append(F.lit(f"[{title}]"))
        parts += [F.lit(f"({hint})") for mark, hint in hints.items() if title.startswith(mark)]
        parts += [F.concat(F.lit(f"- {feature_name(c, style, aliases)}: "), scalar(F.col(c), kind)) for c, kind in columns.items() if feature_group(c) == title]
    return F.concat_ws("\n", *parts, F.lit("Answer:"))


def sort_entities(entities: Column, policy: str) -> Column:
    """Entities (num_msgs, lifetime_fraction, distance_to_ego) by policy: none, msgs_lifetime_distance, or distance first."""
    if policy == "none":
        return entities
    msgs, life, far = (lambda e: -F.coalesce(e["num_msgs"], F.lit(0)).cast("double")), (lambda e: -F.coalesce(e["lifetime_fraction"], F.lit(0.0))), (lambda e: F.coalesce(e["distance_to_ego"], F.lit(1e9)))
    keys = (msgs, life, far) if policy == "msgs_lifetime_distance" else (far, msgs, life)
    tagged = F.transform(entities, lambda e, i: F.struct(*(k(e).alias(f"k{n}") for n, k in enumerate(keys)), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(tagged), lambda x: x["e"])


def entity_line(e: Column) -> Column:
    two = lambda c: scalar(e[c], "double", 2, "-")
    text = lambda c: F.coalesce(e[c].cast("string"), F.lit("-"))
    return F.concat(F.lit("- "), text("pseudo_local_id"), F.lit(": g="), text("group_id"), F.lit(" msgs="), text("num_msgs"), F.lit(" life="), two("lifetime_fraction"), F.lit(" spd="), two("avg_speed"), F.lit(" dist="), two("distance_to_ego"))


def budgeted(lines: Column, costs: Column, budget: Column | int) -> Column:
    """Lines up to the first that overflows the budget; the first line always stays."""
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("kept"), F.lit(True).alias("open"))
    step = lambda a, c: F.struct(
        (a["used"] + F.when(a["open"] & (a["used"] + c <= budget), c).otherwise(0)).cast("long").alias("used"),
        (a["kept"] + F.when(a["open"] & (a["used"] + c <= budget), 1).otherwise(0)).alias("kept"), (a["open"] & (a["used"] + c <= budget)).alias("open"),
    )
    kept = F.aggregate(costs, start, step, lambda a: a["kept"])
    return F.slice(lines, 1, F.greatest(kept, F.lit(1)))


def episode_prompt(summary: list[Column], entities: Column, policy: str, budget: Column | int, question: str) -> Column:
    """Summary lines, entity lines within the budget with how many of them are shown, question and answer mark."""
    lines = F.transform(sort_entities(entities, policy), entity_line)
    shown = F.get(F.transform(F.array(lines), lambda x: F.struct(x.alias("all"), budgeted(x, F.transform(x, token_count), budget).alias("kept"))), F.lit(0))
    n, m = F.size(shown["kept"]), F.size(shown["all"])
    note = F.concat(F.lit("- entities shown: "), n.cast("string"), F.lit("/"), m.cast("string"), F.when(n < m, " (truncated)").otherwise(""))
    return F.concat_ws("\n", F.lit(question), *summary, note, F.array_join(shown["kept"], "\n"), F.lit(""), F.lit("Answer:"))


def visible_labels(true_ids: Column, visible: Column) -> Column:
    """True ids that are visible, in order."""
    return F.filter(true_ids, lambda x: F.array_contains(visible, x))


def outside(pred: Column, visible: Column) -> Column:
    """Predicted ids that were not shown."""
    return F.array_except(pred, visible)


def exact_match(gold: Column, pred: Column) -> Column:
    """Whether the two id sets are equal."""
    return F.array_sort(F.array_distinct(gold)) == F.array_sort(F.array_distinct(pred))


def label_text(y: Column, kind: Column | None = None) -> Column:
    """BENIGN or ATTACK; with the attacker type, ATTACK_TYPE_n where it is known."""
    attack = F.lit("ATTACK") if kind is None else F.when(kind.isNotNull(), F.concat(F.lit("ATTACK_TYPE_"), kind.cast("long").cast("string"))).otherwise("ATTACK")
    return F.when(y == 1, attack).otherwise("BENIGN")


def history_lines(window: Column) -> Column:
    """Lines of a window's items (t, x, y, vx, vy, rssi) with their time before the last one, in order of time."""
    items = F.array_sort(window)
    last = F.array_max(F.transform(window, lambda w: w["t"]))
    return F.transform(items, lambda w: F.concat(F.lit("dt="), F.format_string("%.2f", w["t"] - last), F.lit(" pos="), pair(F.array(w["x"], w["y"])), F.lit(" spd="), pair(F.array(w["vx"], w["vy"])), F.lit(" rssi="), signal(w["rssi"])))


def without_answer(prompt_text: Column) -> Column:
    """A training prompt without its label: the last line becomes a bare answer mark."""
    return F.concat(F.regexp_replace(prompt_text, r"\n[ \t]*Answer:[^\n]*$", ""), F.lit("\nAnswer:"))


def sample_id(run: Column, receiver: Column, start: Column, end: Column) -> Column:
    return F.concat(run, F.lit("|rcv"), receiver.cast("string"), F.lit("|"), start.cast("string"), F.lit("-"), end.cast("string"))
