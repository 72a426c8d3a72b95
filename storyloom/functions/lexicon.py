"""Word lists that classification, tokens and entities are defined by."""

STOPWORDS = tuple(
    """
a an the and or but if then than that this these those of in on at to for with from by
as is are was were be been being it its it's he she they them his her their we you i
not no nor so such too very can will just don should now about after again against all
almost also am among any because before below between both during each few further
have has had having here how into more most only other our out over own same some
what when where which while who whom why would could may might must shall into up down
said says say new news report reports reported according told amid via update updates
""".split()
)

TRACKING_PARAMS = tuple(
    """
utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_name utm_reader utm_brand utm_social
fbclid gclid dclid msclkid igshid mc_cid mc_eid ref referrer source cmpid ncid smid partner
sh spm at_medium at_campaign __twitter_impression cmp ito icid ocid sref guccounter amp
""".split()
)

TOPICS = {
    "business": "market markets stocks shares economy inflation rates bank earnings revenue trade tariff investors recession gdp currency bond ipo".split(),
    "technology": "ai chip chips software startup semiconductor app cloud data cyber robot quantum gpu model platform device silicon algorithm".split(),
    "science": "research study scientists space nasa climate telescope physics genome orbit moon mars discovery experiment species fossil".split(),
    "health": "health disease virus vaccine patients hospital outbreak drug cancer clinical who infection".split(),
    "politics": "election president parliament senate minister vote votes campaign policy congress party government bill coalition referendum".split(),
    "world": "war conflict troops border refugees sanctions summit treaty diplomatic ceasefire strike un".split(),
    "sport": "match goal tournament league champion olympic coach season final cup score player".split(),
    "disaster": "earthquake magnitude hurricane flood wildfire tsunami evacuated quake storm landslide eruption".split(),
}

ENTITY_GLUE = ("of", "the", "de", "and", "for", "und")

ENTITY_NOISE = tuple(
    """
the this that these those there their they them but and for however meanwhile according officials
authorities researchers scientists analysts experts reuters associated press reporting editing additional
monday sunday saturday week year years people government company companies markets market shares
stocks data news report reports study new one two three first last next other more most some
it its he she we you his her
""".split()
)
