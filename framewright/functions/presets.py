"""Class mappings between public label sets."""

from __future__ import annotations

# The COCO label set; id, name and supercategory.
COCO = [
    (1, "person", "person"), (2, "bicycle", "vehicle"), (3, "car", "vehicle"), (4, "motorcycle", "vehicle"), (5, "airplane", "vehicle"),
    (6, "bus", "vehicle"), (7, "train", "vehicle"), (8, "truck", "vehicle"), (9, "boat", "vehicle"), (10, "traffic light", "outdoor"),
    (11, "fire hydrant", "outdoor"), (12, "street sign", "outdoor"), (13, "stop sign", "outdoor"), (14, "parking meter", "outdoor"), (15, "bench", "outdoor"),
    (16, "bird", "animal"), (17, "cat", "animal"), (18, "dog", "animal"), (19, "horse", "animal"), (20, "sheep", "animal"),
    (21, "cow", "animal"), (22, "elephant", "animal"), (23, "bear", "animal"), (24, "zebra", "animal"), (25, "giraffe", "animal"),
    (26, "hat", "accessory"), (27, "backpack", "accessory"), (28, "umbrella", "accessory"), (29, "shoe", "accessory"), (30, "eye glasses", "accessory"),
    (31, "handbag", "accessory"), (32, "tie", "accessory"), (33, "suitcase", "accessory"), (34, "frisbee", "sports"), (35, "skis", "sports"),
    (36, "snowboard", "sports"), (37, "sports ball", "sports"), (38, "kite", "sports"), (39, "baseball bat", "sports"), (40, "baseball glove", "sports"),
    (41, "skateboard", "sports"), (42, "surfboard", "sports"), (43, "tennis racket", "sports"), (44, "bottle", "kitchen"), (45, "plate", "kitchen"),
    (46, "wine glass", "kitchen"), (47, "cup", "kitchen"), (48, "fork", "kitchen"), (49, "knife", "kitchen"), (50, "spoon", "kitchen"),
    (51, "bowl", "kitchen"), (52, "banana", "food"), (53, "apple", "food"), (54, "sandwich", "food"), (55, "orange", "food"),
    (56, "broccoli", "food"), (57, "carrot", "food"), (58, "hot dog", "food"), (59, "pizza", "food"), (60, "donut", "food"),
    (61, "cake", "food"), (62, "chair", "furniture"), (63, "couch", "furniture"), (64, "potted plant", "furniture"), (65, "bed", "furniture"),
    (66, "mirror", "furniture"), (67, "dining table", "furniture"), (68, "window", "furniture"), (69, "desk", "furniture"), (70, "toilet", "furniture"),
    (71, "door", "furniture"), (72, "tv", "electronic"), (73, "laptop", "electronic"), (74, "mouse", "electronic"), (75, "remote", "electronic"),
    (76, "keyboard", "electronic"), (77, "cell phone", "electronic"), (78, "microwave", "appliance"), (79, "oven", "appliance"), (80, "toaster", "appliance"),
    (81, "sink", "appliance"), (82, "refrigerator", "appliance"), (83, "blender", "appliance"), (84, "book", "indoor"), (85, "clock", "indoor"),
    (86, "vase", "indoor"), (87, "scissors", "indoor"), (88, "teddy bear", "indoor"), (89, "hair drier", "indoor"), (90, "toothbrush", "indoor"),
    (91, "hair brush", "indoor"),
]

# The Pascal VOC label set; id, name and the COCO name of it.
VOC = [
    (1, "aeroplane", "airplane"), (2, "bicycle", "bicycle"), (3, "bird", "bird"), (4, "boat", "boat"), (5, "bottle", "bottle"),
    (6, "bus", "bus"), (7, "car", "car"), (8, "cat", "cat"), (9, "chair", "chair"), (10, "cow", "cow"),
    (11, "diningtable", "dining table"), (12, "dog", "dog"), (13, "horse", "horse"), (14, "motorbike", "motorcycle"), (15, "person", "person"),
    (16, "pottedplant", "potted plant"), (17, "sheep", "sheep"), (18, "sofa", "couch"), (19, "train", "train"), (20, "tvmonitor", "tv"),
]

# The COCO supercategories; id and name.
SUPERCATEGORIES = [
    (1, "person"), (2, "vehicle"), (3, "outdoor"), (4, "animal"), (5, "accessory"), (6, "sports"), (7, "kitchen"), (8, "food"), (9, "furniture"), (10, "electronic"), (11, "appliance"), (12, "indoor"),
]

Rows = list[tuple[int, str, int, str]]


def _to_voc() -> Rows:
    ids = {name: i for i, name, _ in COCO}
    return sorted((ids[c], c, i, v) for i, v, c in VOC)


def _to_supercategory() -> Rows:
    ids = {name: i for i, name in SUPERCATEGORIES}
    return [(i, c, ids[s], s) for i, c, s in COCO]


PRESETS = {("coco", "pascalvoc"): _to_voc, ("coco", "supercategory"): _to_supercategory}


def list_presets() -> list[str]:
    """Names of the mappings, those that can be turned round included."""
    both = list(PRESETS) + [(b, a) for (a, b), rows in PRESETS.items() if len({r[2] for r in rows()}) == len(rows())]
    return sorted(f"{a}_to_{b}" for a, b in both)


def load_preset(source: str, target: str) -> tuple[dict[int, int], dict[int, str]]:
    """(id mapping, new names); turned round where only the opposite is there and its output ids are unique."""
    if (source, target) in PRESETS:
        rows = PRESETS[source, target]()
        return {r[0]: r[2] for r in rows}, {r[2]: r[3] for r in rows}
    if (target, source) in PRESETS:
        rows = PRESETS[target, source]()
        if len({r[2] for r in rows}) == len(rows):
            return {r[2]: r[0] for r in rows}, {r[0]: r[1] for r in rows}
    raise ValueError(f"no mapping from {source} to {target}; there are {list_presets()}")
