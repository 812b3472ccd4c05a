"""Word lists and constants of the keyword statistics."""

# These must be as they are for right results.
LATIN_STOPWORDS = (
    "a actually also always an and are as at basically be been being by ever for from how in is it just kind kinda "
    "literally maybe never now of often on or perhaps quite really so sometimes sort sorta that the then this to too "
    "very was well were what when which why with"
).split()
CJK_STOPWORDS = (
    "这种情况 那种情况 一下下 一下子 一会儿 一阵子 可能会 差不多 有时候 有点儿 比如讲 比如说 的时候 的话呢 老实说 说实话 一下 一个 一些 一会 一定 "
    "一次 一直 一边 一阵 不断 不过 之前 之后 也许 于是 什么 他们 以及 以后 但是 例如 依旧 依然 其实 刚刚 刚才 反复 反正 反而 只是 可以 可能 同时 后来 "
    "因为 基本 多半 大多 大概 大约 她们 好像 如果 它们 完全 就是 已经 常常 并且 应该 总之 感觉 我们 或者 所以 明白 是否 有些 有时 有点 每次 比如 比较 "
    "然后 特别 现在 理解 的话 知道 稍微 稍稍 经常 而且 肯定 觉得 认为 还是 还有 这个 这样 这种 这边 这里 那个 那种 那边 那里 需要 非常 也 了 你 吧 呀 "
    "呢 啊 嘛 就 我 挺 的 着 还"
).split()
ALIAS = {"chat_gpt": "chatgpt", "open_ai": "openai", "gpt_4": "gpt4", "gpt_3": "gpt3"}
WHITELIST = ["chatgpt", "openai", "gpt4", "gpt3"]
#: Fixed value: what counts as white space at the ends of names, in order of code points.
SPACE = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
START, END = "__START__", "__END__"
#: Scoring: weight of PMI, weight of entropy, factor of three words, factor of single words.
ALPHA, BETA, GAMMA, DELTA = 0.3, 0.2, 1.15, 0.25
MIN_FREQ, MIN_PMI, WHITELIST_BONUS = 5, 1.5, 1.1
#: Factors for the parts of a phrase that passes.
UNI_OF_BI, UNI_OF_TRI, BI_OF_TRI = 0.85, 0.75, 0.85
TOP_PER_ORDER, MOST_CANDIDATES, TOP_VIEW = 3000, 3000, 10
DAY_MS = 86_400_000
#: The last millisecond that counts as a date.
LAST_MS = 100_000_000 * DAY_MS
