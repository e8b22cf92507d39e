"""The closed vocabulary of danger types and the expressions that map raw labels to it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Protective equipment, then actions; the order is the order of output.
PPE = ["hardhat", "mask", "protective_clothing", "safety_shoes", "gloves", "goggles", "respirator"]
ACTIONS = [
    "missed_inspection", "area_missed_inspection", "unauthorized_intrusion", "overtime_stay",
    "blind_spot_stay", "area_overcapacity", "workshop_overcapacity", "fall_detected",
]
TYPES = PPE + ACTIONS
#: The accepted spellings of each type, in the order in which a filter expands to them.
SPELLINGS = {
    "hardhat": ["hardhat", "no_hardhat"],
    "mask": ["mask", "no_mask"],
    "protective_clothing": [
        "protective_clothing", "no_protective_clothing", "safety_vest", "safety_est",
        "no_safety_vest", "no_safety_est", "work_clothes", "no_work_clothes",
    ],
    "safety_shoes": ["safety_shoes", "protective_shoes", "no_safety_shoes", "no_protective_shoes"],
    "gloves": ["gloves", "no_gloves"],
    "goggles": ["goggles", "no_goggles"],
    "respirator": ["respirator", "gas_mask", "anti_toxic_mask", "no_respirator", "no_gas_mask"],
    "missed_inspection": ["missed_inspection"],
    "area_missed_inspection": ["area_missed_inspection"],
    "unauthorized_intrusion": ["unauthorized_intrusion"],
    "overtime_stay": ["overtime_stay"],
    "blind_spot_stay": ["blind_spot_stay"],
    "area_overcapacity": ["area_overcapacity"],
    "workshop_overcapacity": ["workshop_overcapacity"],
    "fall_detected": ["fall_detected"],
}
#: Labels of the types.
LABELS = {
    "hardhat": "未佩戴安全帽",
    "mask": "未佩戴口罩",
    "protective_clothing": "未穿戴防护服",
    "safety_shoes": "未穿戴防护鞋",
    "gloves": "未佩戴防护手套",
    "goggles": "未佩戴护目镜",
    "respirator": "未佩戴防毒口罩",
    "missed_inspection": "未巡检",
    "area_missed_inspection": "区域漏巡",
    "unauthorized_intrusion": "违规闯入",
    "overtime_stay": "超时驻留",
    "blind_spot_stay": "盲区驻留",
    "area_overcapacity": "区域超员",
    "workshop_overcapacity": "车间超员",
    "fall_detected": "人员跌倒",
}
#: Labels of raw spellings in the event list, and of an empty one.
RAW_LABELS = {
    "no_goggles": "未佩戴护目镜",
    "no_mask": "未佩戴口罩",
    "no_lab_coat": "未穿实验服",
    "lab_coat": "实验服",
    "no_gloves": "未佩戴防护手套",
    "no_head_mask": "未戴头套",
    "head_mask": "头套",
    "no_protective_clothing": "未穿戴防护服",
    "safety_vest": "未穿戴防护服",
    "no_safety_vest": "未穿戴防护服",
    "work_clothes": "未穿戴防护服",
    "no_work_clothes": "未穿戴防护服",
    "no_hardhat": "未佩戴安全帽",
    "no_safety_shoes": "未穿戴防护鞋",
    "protective_shoes": "未穿戴防护鞋",
    "no_protective_shoes": "未穿戴防护鞋",
    "gas_mask": "未佩戴防毒口罩",
    "anti_toxic_mask": "未佩戴防毒口罩",
    "no_respirator": "未佩戴防毒口罩",
    "no_gas_mask": "未佩戴防毒口罩",
    "drinking": "饮水",
    "eating": "进食",
}
NO_LABEL = "未知违规"


def alias_table() -> dict[str, str]:
    """Every accepted spelling with its type."""
    return {spelling: name for name, spellings in SPELLINGS.items() for spelling in spellings}


def expanded(name: str) -> list[str]:
    """The spellings that a filter by ``name`` looks for; an unknown name stands for itself, an empty one for nothing."""
    key = name.strip().lower().replace("-", "_").replace(" ", "_")
    return SPELLINGS.get(key, [key] if key else [])


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def type_label(name: Column) -> Column:
    """The label of a type in any spelling; an unknown one is its own label."""
    key = normal_key(name)
    matched = F.coalesce(literal_map(alias_table())[key], key)
    return F.coalesce(literal_map(LABELS)[matched], matched)


def event_label(raw: Column) -> Column:
    """The label of a raw spelling in the event list: of a type, of a known raw name, else its words."""
    key = normal_key(raw)
    return F.coalesce(literal_map(LABELS)[key], literal_map(RAW_LABELS)[key], F.when(key == "", NO_LABEL).otherwise(F.translate(key, "_", " ")))


def normal_key(label: Column) -> Column:
    return F.translate(F.lower(F.trim(label)), "- ", "__")


def matched_types(*lists: Column) -> Column:
    """Types of the labels of several arrays in first-seen order; unknown labels are dropped."""
    table = literal_map(alias_table())
    both = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])
    return F.array_distinct(F.filter(F.transform(both, lambda x: table[normal_key(x)]), lambda x: x.isNotNull()))


def type_order(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TYPES)), name)
