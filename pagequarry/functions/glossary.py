"""Terms of an interface with their counterparts in another language, found in one pass over a text, and what a test step gains by them."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping

#: English terms of interfaces and what the Chinese edition may show instead, in the order in which alternatives are listed.
TERMS: dict[str, list[str]] = {
    "reading time": ["阅读时间", "阅读时长"], "min read": ["分钟阅读", "阅读时长"], "author": ["作者"], "date": ["日期", "时间"], "read": ["阅读"], "comment": ["评论", "留言"],
    "comments": ["评论", "留言"], "share": ["分享"], "tag": ["标签"], "tags": ["标签"], "previous": ["上一篇", "上一步", "上一个"], "prev": ["上一篇", "上一步", "上一个"],
    "next": ["下一篇", "下一步", "下一个"], "back": ["返回", "后退", "上一步"], "continue": ["继续", "下一步"], "finish": ["完成", "结束"], "turn off": ["关闭"],
    "all lights off": ["全部关灯", "关闭所有灯", "关闭所有"], "lights off": ["关灯", "关闭灯光"], "confirm": ["确认"], "submit": ["提交", "确认"], "save": ["保存"], "cancel": ["取消"],
    "close": ["关闭"], "open": ["打开"], "show": ["显示"], "hide": ["隐藏"], "start": ["开始", "启动"], "begin": ["开始", "启动"], "restart": ["重新开始", "重启"], "play": ["开始", "播放"],
    "pause": ["暂停"], "stop": ["停止"], "reset": ["重置"], "clear": ["清空"], "add to cart": ["加入购物车"], "add": ["添加", "新增"], "new": ["新建", "新增"], "create": ["创建", "新建"],
    "delete": ["删除", "移除"], "remove": ["删除", "移除"], "edit": ["编辑"], "login": ["登录", "登入"], "register": ["注册"], "sign up": ["注册"], "signup": ["注册"], "settings": ["设置"],
    "menu": ["菜单"], "search": ["搜索", "查找"], "filter": ["筛选", "过滤"], "sort": ["排序"], "export": ["导出"], "download": ["下载"], "print": ["打印"], "copy": ["复制"],
    "like": ["点赞", "喜欢"], "favorite": ["收藏", "喜欢"], "heart": ["收藏", "喜欢"], "helpful": ["有帮助"], "yes": ["是", "有用"], "no": ["否", "无用"], "buy": ["购买"],
    "order": ["下单", "订单"], "cart": ["购物车"], "checkout": ["结账", "结算"], "reserve": ["预订", "预约"], "reservation": ["预订", "预约"], "book": ["预订", "预约"], "ticket": ["门票", "票"],
    "rsvp": ["报名", "预约"], "contact sales": ["联系销售"], "contact": ["联系"], "get in touch": ["联系", "联系我们"], "send": ["发送", "提交"], "reply": ["回复"], "message": ["消息", "留言"],
    "chat": ["聊天", "对话"], "admin": ["管理", "管理员"], "dashboard": ["仪表板", "看板"], "analytics": ["分析", "统计"], "overview": ["概览", "总览"], "details": ["详情", "详细信息"],
    "detail": ["详情"], "gallery": ["图库", "画廊"], "features": ["功能", "特性"], "feature": ["功能", "特性"], "demo": ["演示"], "guide": ["指南"], "tutorial": ["教程"],
    "faq": ["常见问题", "问答"], "question": ["问题"], "general": ["通用", "常规"], "billing": ["账单", "计费"], "technical": ["技术"], "introduction": ["介绍", "简介"], "configuration": ["配置"],
    "authentication": ["认证", "身份验证"], "auth": ["认证", "身份验证"], "endpoint": ["接口", "端点"], "endpoints": ["接口", "端点"], "request": ["请求"], "response": ["响应"],
    "reference": ["参考", "文档"], "examples": ["示例", "例子"], "errors": ["错误"], "warning": ["警告"], "success": ["成功"], "info": ["信息", "提示"], "required": ["必填", "必需"],
    "invalid": ["无效", "错误"], "no results": ["无结果", "未找到"], "not found": ["未找到", "找不到"], "score": ["分数", "得分"], "level": ["关卡", "等级"], "time": ["时间"],
    "timer": ["计时器", "倒计时"], "health": ["生命值", "血量"], "lives": ["生命", "生命数"], "life": ["生命"], "coins": ["金币"], "coin": ["金币"], "stars": ["星星"], "star": ["星星"],
    "speed": ["速度"], "wave": ["波次", "关卡"], "move": ["移动"], "turn": ["回合", "轮到"], "winner": ["胜者", "获胜"], "win": ["胜利", "获胜"], "black": ["黑色", "黑棋"],
    "white": ["白色", "白棋"], "scoreboard": ["计分板"], "revenue": ["收入", "营收"], "orders": ["订单"], "customers": ["客户", "顾客"], "conversion": ["转化率"], "sales": ["销售", "销量"],
    "price": ["价格"], "pricing": ["价格", "定价"], "subtotal": ["小计"], "total": ["总计", "合计"], "quantity": ["数量"], "qty": ["数量"], "stock": ["股票", "库存"], "stocks": ["股票", "库存"],
    "bond": ["债券"], "bonds": ["债券"], "cash": ["现金"], "crypto": ["加密货币", "数字货币"], "real estate": ["房地产", "不动产"], "fund": ["基金"], "portfolio": ["投资组合"],
    "holding": ["持仓"], "holdings": ["持仓"], "allocation": ["配置", "分配"], "risk": ["风险"], "return": ["收益", "回报"], "benchmark": ["基准"], "dividend": ["股息", "分红"],
    "income": ["收入"], "category": ["分类", "类别"], "product": ["产品"], "products": ["产品"], "humidity": ["湿度"], "wind": ["风速"], "temperature": ["温度"], "weather": ["天气"],
    "goal": ["目标"], "progress": ["进度"], "water": ["水", "饮水"], "history": ["历史", "记录"], "today": ["今天"], "tomorrow": ["明天"], "spring": ["春", "春季"], "summer": ["夏", "夏季"],
    "autumn": ["秋", "秋季"], "fall": ["秋", "秋季"], "winter": ["冬", "冬季"], "monthly": ["月度", "每月"], "annual": ["年度", "年付"], "yearly": ["年度", "年付"], "month": ["月"],
    "year": ["年"], "light": ["浅色", "明亮", "灯", "灯光"], "lights": ["灯", "灯光"], "dark": ["暗色", "深色"], "theme": ["主题"],
}
#: Names of months and days, and the numerals in what stands for them.
MONTHS, DAYS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
NUMERALS = ("一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十一", "十二")
TERMS |= {name: [f"{NUMERALS[i]}月", f"{i + 1}月"] for i, name in enumerate(MONTHS)}
TERMS |= {name: [f"周{day}", f"星期{day}"] for name, day in zip(DAYS, [*NUMERALS[:6], "日"], strict=True)}

#: A term that gives way to a longer one; what reads a page's text or its source; regular expressions that are no texts.
YIELDS = {"turn": "turn off"}
TEXT_READS = ("innerText", "textContent", "aria-label", "placeholder", "document.body.innerText", "document.body.textContent")
SOURCE_READS = ("innerHTML", "outerHTML")
NO_TEXTS = ("unexpected token", "unexpected end of input", "referenceerror", "typeerror", "syntaxerror", "is not defined", "undefined", "nan", "object object", "\\{\\{")
#: The patterns of what is rewritten, and what a pattern's signs are blanked by before terms are sought.
SIGNS = re.compile(r"\\[bBdDsSwW]|\(\?:|\(\?i\)|[\[\]{}^$+*?.()]")
LITERAL = re.compile(r"/((?:\\.|[^/\\\n])+)/([dgimsuvy]*)")
ARRAY = re.compile(r"(patterns\s*=\s*\[)(.*?)(\])", re.DOTALL)
QUOTED = re.compile(r"([\"'])(.*?)(?<!\\)\1", re.DOTALL)
INCLUDES = re.compile(r"\b(?P<var>text|t|body)\.includes\((?P<quote>[\"'])(?P<value>[^\"']{2,80})(?P=quote)\)")
#: Length and number of terms from which on an expression is a risk.
RISK_LENGTH, RISK_TERMS = 2000, 4

GAP, END = " ", ""
_letter = re.compile("[a-z0-9]").match
_gap = re.compile(r"[\s_\-]*").match


class Glossary:
    """A trie of terms.  A text is walked once from each place where a word can begin; blanks of a term stand for any run of blanks,
    underscores and hyphens, or none."""

    def __init__(self, terms: Mapping[str, Iterable[str]] = TERMS):
        self.terms = {t: list(a) for t, a in terms.items()}
        self.rank = {t: i for i, t in enumerate(self.terms)}
        self.root: dict = {}
        for term in self.terms:
            node = self.root
            for c in term.lower():
                node = node.setdefault(c, {})
            node[END] = term

    def found(self, text: str) -> set[str]:
        """The terms that occur in a text as words, once the signs of patterns are blanks."""
        probe = SIGNS.sub(" ", text.lower()).replace("ſ", "s")
        out: set[str] = set()
        for start in range(len(probe)):
            if probe[start] not in self.root or (start and _letter(probe[start - 1])):
                continue
            walks = [(self.root, start)]
            while walks:
                node, at = walks.pop()
                if END in node and not _letter(probe, at):
                    out.add(node[END])
                if GAP in node:
                    walks.append((node[GAP], _gap(probe, at).end()))
                if at < len(probe) and probe[at] != GAP and probe[at] in node:
                    walks.append((node[probe[at]], at + 1))
        return out

    def alternatives(self, text: str) -> list[str]:
        """Counterparts of a text's terms that it doesn't hold yet, in the glossary's order."""
        there = self.found(text)
        kept = sorted((t for t in there if YIELDS.get(t) not in there), key=self.rank.__getitem__)
        return list(dict.fromkeys(a for t in kept for a in self.terms[t] if a not in text))

    def pattern(self, text: str) -> tuple[str, int]:
        added = self.alternatives(text)
        return "|".join([text, *map(re.escape, added)]), len(added)

    def expression(self, text: str) -> tuple[str, dict[str, int]]:
        """A script whose regular expressions, pattern lists and ``includes`` calls accept both languages, and counts of what was changed."""
        counts = dict.fromkeys(("regexes", "entries", "includes"), 0)

        def literal(m: re.Match) -> str:
            wider, added = (m[1], 0) if any(x in m[1].lower() for x in NO_TEXTS) else self.pattern(m[1])
            counts["regexes"] += added > 0
            return f"/{wider}/{m[2]}" if added else m[0]

        def array(m: re.Match) -> str:
            held = m[2]
            added = list(dict.fromkeys(a for q in QUOTED.finditer(held) for a in self.alternatives(q[2]) if a not in held))
            counts["entries"] += len(added)
            comma = "" if not held.strip() or held.rstrip().endswith(",") else ","
            return m[1] + held + comma + ",".join(json.dumps(a, ensure_ascii=False) for a in added) + m[3] if added else m[0]

        def includes(m: re.Match) -> str:
            added = self.alternatives(m["value"])
            counts["includes"] += bool(added)
            return "(" + "||".join([m[0], *(f"{m['var']}.includes({json.dumps(a, ensure_ascii=False)})" for a in added)]) + ")" if added else m[0]

        for what, how in ((LITERAL, literal), (ARRAY, array), (INCLUDES, includes)):
            text = what.sub(how, text)
        return text, counts

    def step(self, step: Mapping) -> dict:
        """What becomes of a step (action, text, text_pattern, expression): new values and counters; an empty dict where nothing does."""
        action, out = step.get("action"), {}
        if action in ("assert_text_contains", "assert_text_not_contains", "click_text"):
            wider, added = self.pattern(str(step.get("text_pattern") or step.get("text") or ""))
            if added:
                kind = "click" if action == "click_text" else "text"
                out = {"text_pattern": wider, f"{kind}_steps": 1, f"{kind}_alternatives": added}
        elif action in ("assert_js_value", "eval_js"):
            old = str(step.get("expression") or "")
            if not any(x in old for x in TEXT_READS):
                return out
            if any(x in old for x in SOURCE_READS):
                return {"source_skipped": 1}
            if len(old) > RISK_LENGTH or (("&&" in old or "||" in old) and len(self.found(old)) >= RISK_TERMS):
                out["risky"] = 1
            new, counts = self.expression(old)
            if new != step.get("expression"):
                out |= {"expression": new, "script_steps": 1, **counts}
        return out
