"""Small networks with known measures, and tables made of them."""

from itertools import combinations

CLIQUES = [*combinations(["ava", "ben", "cai", "dee"], 2), *combinations(["eli", "fay", "gus", "ivy"], 2), ("hal", "ava"), ("hal", "cai"), ("hal", "eli"), ("hal", "gus")]
TEAMS = {**dict.fromkeys(["ava", "ben", "cai", "dee"], "Engineering"), **dict.fromkeys(["eli", "fay", "gus", "ivy"], "Product")}
PATH = list(zip("ABCDE", "BCDEF"))
STAR = [("hub", f"L{i}") for i in range(1, 6)]
RING = [(f"{i:02}", f"{(i + k) % 20:02}") for i in range(20) for k in (1, 2)]
SMALL_WORLD = RING + [("00", "10"), ("05", "15")]
CLASS = [("leo", "priya"), ("leo", "sam"), ("priya", "sam"), ("sam", "mina"), ("priya", "mina"), ("diego", "farah"), ("diego", "ben"), ("farah", "chloe"), ("ben", "chloe"), ("farah", "ben"),
         ("aisha", "emma"), ("aisha", "gabe"), ("emma", "omar"), ("gabe", "omar"), ("emma", "gabe"), ("mina", "diego"), ("chloe", "aisha"), ("leo", "omar")]
MAJORS = {**dict.fromkeys(["leo", "priya", "sam", "mina"], "CS"), **dict.fromkeys(["diego", "farah", "ben", "chloe"], "Economics"), **dict.fromkeys(["aisha", "emma", "gabe", "omar", "nora"], "Sociology")}
CLUBS = [("ana", "chess"), ("ana", "choir"), ("ben", "chess"), ("ben", "choir"), ("cara", "choir"), ("cara", "drama"), ("dev", "drama"), ("dev", "robotics"), ("eli", "robotics"), ("fay", "robotics")]
#: Friendships of the karate club (Zachary 1977) by the lower of two members, and the members who stayed with the instructor when it split.
KARATE_FRIENDS = {
    1: [2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 18, 20, 22, 32],
    2: [3, 4, 8, 14, 18, 20, 22, 31],
    3: [4, 8, 9, 10, 14, 28, 29, 33],
    4: [8, 13, 14],
    5: [7, 11],
    6: [7, 11, 17],
    7: [17],
    9: [31, 33, 34],
    10: [34],
    14: [34],
    15: [33, 34],
    16: [33, 34],
    19: [33, 34],
    20: [34],
    21: [33, 34],
    23: [33, 34],
    24: [26, 28, 30, 33, 34],
    25: [26, 28, 32],
    26: [32],
    27: [30, 34],
    28: [34],
    29: [32, 34],
    30: [33, 34],
    31: [33, 34],
    32: [33, 34],
    33: [34],
}
KARATE_INSTRUCTOR = [1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 17, 18, 20, 22]
KARATE = [(a, b) for a, friends in KARATE_FRIENDS.items() for b in friends]


def ties(spark, edges, both=False):
    """Ties (src, dst, w) of named pairs; an undirected pair is one tie, its lower name first."""
    rows = [(a, b, 1.0) if both else (*sorted((a, b)), 1.0) for a, b, *_ in edges]
    return spark.createDataFrame(rows, "src string, dst string, w double")


def groups(spark, of):
    return spark.createDataFrame(list(of.items()), "node string, grp string")


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in sorted(names)], "node string")
