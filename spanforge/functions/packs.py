"""Vocabularies of one kind of document (delivery-station policies) as data. Engine code takes them as parameters and holds none itself."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Pack:
    """Words that rules look for; every list may be empty, which switches its rule off."""

    visual_labels: list[str] = field(default_factory=list)
    table_terms: list[str] = field(default_factory=list)
    table_labels: str = ""
    review_labels: str = ""
    image_labels: str = ""
    score_formula: str = ""
    watermarks: str = ""
    suspect_characters: str = ""
    policy_words: str = ""
    policy_header: list[str] = field(default_factory=list)
    content_header: str = ""
    condition_header: str = ""
    detail_header: str = ""
    merged_words: str = ""
    native_words: str = ""
    preserved_terms: list[str] = field(default_factory=list)
    key_terms: list[str] = field(default_factory=list)
    high_risk_terms: list[str] = field(default_factory=list)
    region_terms: list[str] = field(default_factory=list)
    review_markers: list[str] = field(default_factory=list)
    clean_fields: str = ""
    region_anchors: list[str] = field(default_factory=list)
    raw_terms: list[str] = field(default_factory=list)
    raw_row_terms: list[str] = field(default_factory=list)
    raw_anchors: list[str] = field(default_factory=list)
    image_terms: list[str] = field(default_factory=list)
    formula_lead: str = ""
    formula_item: str = ""
    not_headings: list[str] = field(default_factory=list)
    contents_exempt: str = ""


EMPTY = Pack()

#: The words of the policy pack, as its rules need them.
POLICY = Pack(
    visual_labels=["特殊场景完成单占比", "复合准时率", "配送原因未完成率", "承托比", "虚假点送达率", "复合超时时长", "站点组体验总得分", "站点组KA品牌单体验得分", "客诉虚假点送达率"],
    table_terms=["站点", "骑手", "排班", "时段", "出勤", "合格", "考核", "班次", "烽火台", "目标值", "数据查询", "数据来源"],
    table_labels=r"(?:数|率|值|占比|时段|骑手|站点)[】）)]?",
    review_labels=r"率|比|得分|占比|时长|单量|完成|公式|口径|定义",
    image_labels=r"公式|计算口径|计算路径|率|占比|承托比|时长|得分|SUM|Σ|分子|分母",
    score_formula=r"(?i)(?:金额|权重占比|奖励|服务费|得分|单量)[^。；;]{0,40}[=＝].*(?:sum|Σ|\\+|[+＋*×])",
    policy_words=r"释义|说明|数据来源|考核范围|查询路径|申诉|规则|事件|细则|管理目标|补充说明|参考指标|指标定义|计分|核算|公式|责任承担|整改|违约金|检核项目|提报条件|剔除条件",
    policy_header=["一级分类", "检核项目", "内容", "责任承担"],
    content_header=r"内容|责任承担|检核项目",
    condition_header=r"提报条件|剔除条件",
    detail_header=r"释义|数据来源|事件细则|查询路径",
    merged_words=r"合并|多层|普通场景|特殊场景|融合后|计分规则",
    native_words=r"责任承担|整改|违约金|检核项目|考核范围|数据来源|指标说明|查询路径|申诉|特殊说明|管理规范|安全|站点|骑手",
    preserved_terms=["申诉路径", "申诉场景", "查询路径", "数据来源", "数据获取方式", "指标说明", "考核范围", "核算公式", "计算公式", "责任承担"],
    key_terms=["考核目标", "考核目标举例", "核算公式", "计算公式", "计分公式", "计分规则", "指标定义", "得分范围", "数据来源", "普通场景算分示例", "特殊场景算分示例", "融合后体验得分", "特殊场景完成单占比", "完成单占比", "分子数值", "分母数值", "达标率", "满分目标", "权重"],
    high_risk_terms=["考核目标", "考核目标举例", "核算公式", "计算公式", "计分公式", "指标定义", "得分范围", "普通场景算分示例", "特殊场景算分示例", "融合后体验得分"],
    review_markers=["图示/低置信区域未能可靠文本化", "低置信区域（需核对）", "表格结构需核对", "公式原文（需核对）"],
    clean_fields=r"\A\d{1,2}[.．]\s*站点ID[:：]\s*_?站点名称\z",
    region_terms=["检核", "管控规则", "违规说明", "消毒", "装备", "早会", "考核规则", "考核目标", "核算公式", "计算公式", "指标定义", "数据来源", "查询路径", "申诉", "责任承担", "违约", "整改"],
    region_anchors=["线下检核", "线上视频检核", "站点线上早会", "骑手餐箱消毒", "骑手装备检核", "区域商管控规则", "物防设施管理", "责任承担", "查询路径", "申诉路径", "整改", "违约", "检核项目", "内容", "考核方式", "考核指标", "天气等级", "考核规则", "考核目标", "普通场景算分示例", "特殊场景算分示例", "融合后体验得分", "指标", "分子数值", "分母数值", "达标率", "满分目标", "权重", "数据来源", "普通场景", "特殊场景", "备注"],
    raw_terms=["考核规则", "考核目标", "核算公式", "计算公式", "指标定义", "数据来源", "普通场景算分示例", "特殊场景算分示例", "融合后体验得分", "降星规则", "查询路径"],
    raw_row_terms=["指标", "规则", "备注", "得分", "权重"],
    raw_anchors=["考核方式", "考核指标", "天气等级", "考核规则", "考核目标", "考核目标举例", "普通场景体验满分目标", "特殊场景体验满分目标", "核算公式", "普通场景算分示例", "特殊场景算分示例", "融合后体验得分", "指标", "分子数值", "分母数值", "达标率", "满分目标", "权重", "得分", "普通场景", "特殊场景", "备注", "数据来源", "查询路径", "KA品牌负向反馈率", "虚假点送达率", "虚假点送达", "配送原因未完成率", "复合准时率", "承托比", "复合超时时长", "KA品牌客诉率", "40天气免责", "HD尾单", "专送兜底"],
    image_terms=["公式", "计算口径", "指标", "数据来源", "考核范围", "规则", "得分", "费率", "金额", "单量", "完成率", "达标率"],
    formula_lead=r"\A.*?(?:结果计算公式|计算方式|核算公式|计算公式|计分公式)[:：]?|\A(?:核算公式|计算公式|计分公式|计分规则\d*|指标定义)",
    formula_item=r"\A(?:考核项|项目|指标|内容|列\d+)[:：]?",
    not_headings=["订单占比", "口径准时率", "完成订单量"],
    contents_exempt=r"\A(?:目的|附则)\z",
)
