"""Default vocabulary for hotel reviews (our own word lists).

Fixed values, in natural order: aspect terms (term -> report section) and
polarity words (word -> +1 praise / -1 criticism).  Pass other lists to
``aspects.mentions`` for other domains or languages.
"""

HOTEL_LEXICON = [
    ("room", "accommodation"), ("rooms", "accommodation"), ("bed", "accommodation"),
    ("beds", "accommodation"), ("bathroom", "accommodation"), ("shower", "accommodation"),
    ("towels", "accommodation"), ("view", "accommodation"), ("balcony", "accommodation"),
    ("aircon", "accommodation"), ("ac", "accommodation"), ("noise", "accommodation"),
    ("cleanliness", "accommodation"), ("housekeeping", "accommodation"),
    ("staff", "service"), ("service", "service"), ("reception", "service"), ("receptionist", "service"),
    ("manager", "service"), ("checkin", "service"), ("check-in", "service"), ("checkout", "service"),
    ("hospitality", "service"), ("waiter", "service"), ("waiters", "service"),
    ("pool", "amenities"), ("gym", "amenities"), ("spa", "amenities"), ("parking", "amenities"),
    ("wifi", "amenities"), ("lift", "amenities"), ("elevator", "amenities"), ("garden", "amenities"),
    ("beach", "amenities"), ("facilities", "amenities"),
    ("food", "food_and_dining"), ("breakfast", "food_and_dining"), ("dinner", "food_and_dining"),
    ("lunch", "food_and_dining"), ("restaurant", "food_and_dining"), ("buffet", "food_and_dining"),
    ("menu", "food_and_dining"), ("coffee", "food_and_dining"), ("bar", "food_and_dining"),
    ("location", "location_and_accessibility"), ("area", "location_and_accessibility"),
    ("access", "location_and_accessibility"), ("road", "location_and_accessibility"),
    ("airport", "location_and_accessibility"), ("station", "location_and_accessibility"),
    ("transport", "location_and_accessibility"), ("neighbourhood", "location_and_accessibility"),
    ("price", "value_for_money"), ("prices", "value_for_money"), ("value", "value_for_money"),
    ("rate", "value_for_money"), ("cost", "value_for_money"), ("money", "value_for_money"),
    ("website", "online_presence"), ("booking", "online_presence"), ("reservation", "online_presence"),
    ("photos", "online_presence"), ("listing", "online_presence"), ("app", "online_presence"),
]

HOTEL_POLARITY = [
    ("good", 1), ("great", 1), ("excellent", 1), ("nice", 1), ("clean", 1), ("comfortable", 1),
    ("friendly", 1), ("helpful", 1), ("polite", 1), ("spacious", 1), ("beautiful", 1), ("amazing", 1),
    ("awesome", 1), ("delicious", 1), ("tasty", 1), ("quiet", 1), ("fresh", 1), ("convenient", 1),
    ("cheap", 1), ("affordable", 1), ("worth", 1), ("fast", 1), ("quick", 1), ("lovely", 1),
    ("best", 1), ("perfect", 1), ("wonderful", 1), ("pleasant", 1), ("recommended", 1),
    ("bad", -1), ("poor", -1), ("dirty", -1), ("rude", -1), ("slow", -1), ("noisy", -1), ("small", -1),
    ("smelly", -1), ("broken", -1), ("old", -1), ("expensive", -1), ("overpriced", -1), ("cold", -1),
    ("uncomfortable", -1), ("terrible", -1), ("worst", -1), ("horrible", -1), ("awful", -1),
    ("unhelpful", -1), ("disappointing", -1), ("stale", -1), ("crowded", -1), ("far", -1),
    ("misleading", -1), ("wrong", -1), ("late", -1), ("damaged", -1),
]
