"""What an archive's pages have by convention: its series, hosts, media words, prompts. All of it is a
parameter; the defaults fit the test archive."""

from __future__ import annotations

from dataclasses import dataclass

from newsloom.functions.text import WS


def alternatives(words) -> str:
    """A pattern of plain words, the longest first."""
    import re

    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


@dataclass(frozen=True)
class Conventions:
    """Names and patterns of one archive (patterns in Java syntax)."""

    #: The numbered series, its label in page titles, and its id.
    series_title: str = "晚谈"
    series_id: str = "main"
    #: Labels of series that a news title doesn't repeat.
    series_labels: tuple[str, ...] = ("晚谈", "参阅", "每日简讯", "来论", "夜读", "产经", "直播")
    #: How guests address the host, at the start of a prompt; and trigrams that this makes common.
    hosts: tuple[str, ...] = ("主持人",)
    stop_trigrams: tuple[str, ...] = ()
    archive_base: str = "https://read.news-archive.example/"
    # Words of media blocks, and of paragraphs that only lead to media.
    media: str = "Tabs|B站|西瓜视频|YouTube|播客"
    media_lead: str = "Tabs|B站|西瓜视频|YouTube|播客|以下文本为"
    # Where a prompt opens another topic, reports something, or follows up.
    transition: str = (
        "接下来|下面|再来看看|再看|最后|另一个|另外(?:一|个|则|条)|还有(?:一|个|则|条)|下一(?:个|则|条)|第二(?:个|则|条)|第三(?:个|则|条)|国际新闻|国内新闻|最近(?:有|一|，|,)|前天的消息|昨天的消息"
    )
    date_lead: str = rf"(?:当地时间{WS}*)?(?:(?:18|19|20)?\d{{2}}年{WS}*)?(?:\d{{1,2}}月\d{{1,2}}[日号]|昨天|前天|本周|上周|近日|日前|今年|去年|这个月|刚刚过去的)"
    reporting: str = "报道|消息|通报|发布|宣布|披露|发生|去世|辞职|当选|开工|投产|判决|调查|改革|袭击|事故|会议|文件|数据|研究|公司|政府|法院|委员会|总统|部长"
    follow_up: str = "那|那么|这个|这次|这种|这些|为什么|怎么|就是说|也就是说|如果|既然|所以|有人|你(?:觉得|认为|怎么看)|对于|从.+看|相比|前面|上面|刚才|除了|过去几年|这之后"
    prompt_lead: str = (
        rf"(?:接下来|下面|再来看看|再看|最后|另外|另一个|还有|下一条|下一则){WS}*(?:我们)?{WS}*(?:来)?{WS}*(?:看看)?{WS}*(?:国际|国内)?{WS}*(?:新闻|消息)?[，。：:\s　]*"
    )

    @property
    def greeting(self) -> str:
        return rf"(?:大家好[，,\s]|(?:19|20)\d{{2}}年.+欢迎收看).*(?:欢迎收看|{self.series_title})"


DEFAULT = Conventions()
