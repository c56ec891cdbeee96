"""Values that must stay as they are for results to be comparable."""

# --- fixed values -----------------------------------------------------------

# Characters that separate tokens: ASCII punctuation, space, tab, line ends.
SEPARATORS = r"[ -/:-@\[-`{-~\t\n\r]"

STOP_WORDS = [
    "what", "is", "the", "a", "an", "in", "on", "at", "to", "for", "of", "and",
    "or", "how", "does", "do", "can", "will",
]

ENTITY_TYPES = ["CONCEPT", "PERSON", "ORG", "TECHNOLOGY"]

ENTITY_NOISE = (r"(?i)^[a-z][0-9]?$|^\d|^[A-Z]{1,2}$|rc\d|coupled mode|\(ms\)|version"
                r"|^(the|and|for|with)$")

CONTENT_TYPE_ORDER = ["text", "image", "table", "code", "formula"]

ORDER_STATUSES = ["pending", "processing", "shipped", "delivered", "cancelled"]

FUNNEL_LABELS = ("view", "cart", "purchase")

SPAN_DURATION_METRIC = "traces.span.metrics.duration"

FIRST_NAMES_EVEN = [
    "Thad", "Eddie", "George", "Oliver", "Recip", "Phil", "Boris", "Jim",
    "Yusuf", "Tariq", "Abdul", "Sultan", "Irwin", "Jackson", "William", "Robert",
]
FIRST_NAMES_ODD = [
    "Mary", "Diane", "Betty", "Stephanie", "Gwen", "Clarice", "Brigitte", "Elyssa",
    "Rabbia", "Yasmine", "Wilhemina", "Selena", "Sonya", "Kayla", "Frances", "Abigail",
]
LAST_NAMES = [
    "Thompson", "Graham", "Underwood", "Byrd", "Rivera", "Bryant", "Powell", "Berry",
    "Perkins", "Wise", "Shaw", "Hunter", "Lloyd", "Long", "Hayes", "Burns",
]

# Histogram resolution by length of the range: (at least, unit) -> (value, unit).
INTERVAL_LADDER = [
    ((3, "year"), (1, "month")),
    ((1, "year"), (1, "week")),
    ((1, "month"), (1, "day")),
    ((1, "week"), (12, "hour")),
    ((4, "day"), (3, "hour")),
    ((1, "day"), (1, "hour")),
    ((16, "hour"), (30, "minute")),
    ((8, "hour"), (10, "minute")),
    ((2, "hour"), (5, "minute")),
    ((38, "minute"), (1, "minute")),
    ((13, "minute"), (30, "second")),
    ((6, "minute"), (10, "second")),
    ((4, "minute"), (5, "second")),
    ((1, "minute"), (1, "second")),
]

# Catalogue entries (category, product), looked up by product id modulo the list length.
PRODUCT_CATALOGUE = [
    ("Men's Clothing", "T-shirt - basic"),
    ("Men's Clothing", "Polo shirt - navy"),
    ("Men's Clothing", "Jeans - slim fit"),
    ("Men's Clothing", "Hoodie - black"),
    ("Men's Clothing", "Sweater - grey"),
    ("Men's Clothing", "Jacket - casual"),
    ("Men's Shoes", "Casual lace-ups - sand"),
    ("Men's Shoes", "Trainers - white"),
    ("Men's Shoes", "Boots - leather brown"),
    ("Men's Shoes", "Loafers - suede"),
    ("Men's Shoes", "Running shoes"),
    ("Men's Accessories", "Laptop bag - black/brown"),
    ("Men's Accessories", "Watch - silver"),
    ("Men's Accessories", "Belt - leather"),
    ("Men's Accessories", "Wallet - black"),
    ("Women's Clothing", "Dress - summer floral"),
    ("Women's Clothing", "Blouse - silk"),
    ("Women's Clothing", "Jeans - high waist"),
    ("Women's Clothing", "Cardigan - cashmere"),
    ("Women's Clothing", "Coat - winter"),
    ("Women's Shoes", "Heels - stiletto black"),
    ("Women's Shoes", "Flats - ballet"),
    ("Women's Shoes", "Boots - ankle"),
    ("Women's Shoes", "Sneakers - platform"),
    ("Women's Shoes", "Sandals - strappy"),
    ("Women's Accessories", "Handbag - tote"),
    ("Women's Accessories", "Earrings - gold"),
    ("Women's Accessories", "Necklace - pendant"),
    ("Women's Accessories", "Scarf - printed"),
    ("Women's Accessories", "Watch - rose gold"),
]

# Fixed values of the explanations of ranks and scores: the rank and the insight rank of an absent row, the best ranks,
# the near ranks, and the margin and floor of scores.
ABSENT_RANK = 999
ABSENT_INSIGHT_RANK = 99
BEST_RANKS = 2
NEAR_RANKS = 3
STRONG_MARGIN = 0.15
KEYWORD_FLOOR = 0.7
