"""Prompts of the description and rerank models, and the chat format around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The templates are fixed values; {} is where the text goes.
ONTOLOGY = "There is a central entity, along with its neighbors and its properties. Generate a short, ontological description of the entity based on its triples in English. Here is the triplet of that entity:"
DISTINGUISH = "You generate a strongly distinguishable description of the entity based on the name of the entity provided to you."
INTRODUCE = "Now that you are an encyclopedia, please give a brief introduction to the entities provided to you.\n"
ATTENTION = """

Attention:
1.All answers are in English. If the entity name provided to you is not in English, please first translate it into English.
2.Do not output inferences, only the final introduction.
3.Introduce the English name (or translated name), type and other proprietary information of the entity.
4.The output format is :
Type: 
Proprietary information: """
HELPFUL, MEDICAL = "You are a helpful assistant.", "You are a medical expert."
#: By prompt type: the system message (None: no chat format) and the template.
TEMPLATES: dict[str, tuple[str | None, str]] = {
    "llama2-chat": (None, "[INST]\n{} [/INST]"),
    "mistral-instruct": (None, f"[INST]{ONTOLOGY}\n{{}} \bAnswer in English![/INST]"),
    "qwen2-chat": (HELPFUL, f"{ONTOLOGY} {{}} \nAnswer in English!"),
    "qwen2-chat-translation": (HELPFUL, f"[INST]{DISTINGUISH} These include the ontology type of the entity, the information entropy of the entity is high information. All answers are in English (if non-English words are encountered, the answer is translated into English).\n{{}}[/INST]"),
    "qwen2_chat_chinese_translation_template": (None, "请根据提供给您的实体名称，三元组关系生成该实体的总结。请全部使用英文回答。Please generate a strongly distinguishable and brief summary of the entity based on the name of the entity provided to you, the triplet relationship. All answers will be in English.\n{}"),
    "qwen2_chat_med_bbk_9k_vanilla_template": (MEDICAL, "你是一名医学领域专家，现在给你一个医学名词或者相关信息，请你根据提供的信息对该医学名词生成一段详细描述。\n注意：\n1.有些医学名词没有具体的名称，只有代号（比如a348921），这时候你需要根据图谱中它的邻居信息和属性信息进行推断。\n2.不要输出推断信息，只输出最后的描述即可。\n3.请使用中文回答。\n{}"),
    "mistral_instruct_template_only_name_translation": (None, f"[INST]{DISTINGUISH} The entity name is surrounded by <\t>.\n<\t>{{}}<\t>\nIf the name of the entity is not in English, translate it into English.[/INST]"),
    "qwen2_chat_template_only_name_translation": (HELPFUL, "Now that you are an encyclopedia, ask you to explain and describe the entities provided to you. \nEntity: {}\nAttention: \n1. All answers are in English. If the entity name provided to you is not in English, please first translate it into English. \n2. Don't output inferences, just the final description. \n3. Use your knowledge to describe the entity."),
    "qwen2_chat_template_only_name_1": (HELPFUL, f"{INTRODUCE}Entity: {{}}{ATTENTION}"),
    "qwen2_chat_template_only_name_2": (HELPFUL, f"{INTRODUCE}Entity and Triples: {{}}{ATTENTION}"),
    "mistral_instruct_template_only_name_2": (None, f"[INST]{INTRODUCE}Entity and Triples: {{}}{ATTENTION}[/INST]"),
}
GIVEN = "Given an entity and a set of candidate entities, find the entity representing the same object from the set of candidate entities. Based only on the information provided to you. There has to be a right answer."
#: Rerank instructions by number: where the demonstration, the entity and the candidates go (fixed values).
RERANK = {
    1: f"{{}}{GIVEN} The final answer is output as follows: The correct answer : (CHOICE).\nEntity:\n{{}}\nCandidate entity:\n{{}}\nAnalysis:\n",
    2: f"{{}}{GIVEN} After the analysis is complete, output the correct answer in this format.\nEntity:\n{{}}\nCandidate entity:\n{{}}\nAnalysis:\n",
    3: f'{{}}{GIVEN} Be sure to write "The correct answer: ()" at the end.\nEntity:\n{{}}\nCandidate entity:\n{{}}\n\n',
}


def fill(template: str, *texts: Column) -> Column:
    """The template with its {} replaced in turn; a null text makes a null."""
    parts = template.split("{}")
    if len(parts) != len(texts) + 1:
        raise ValueError("the template takes another number of texts")
    out = [F.lit(parts[0])]
    for text, after in zip(texts, parts[1:], strict=True):
        out += [text, F.lit(after)]
    return F.concat(*out)


def chat(system: str, user: Column) -> Column:
    """System and user turns with role marks, and the start of the answer."""
    return F.concat(F.lit(f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n"), user, F.lit("<|im_end|>\n<|im_start|>assistant\n"))


def construct(prompt_type: str, text: Column) -> Column:
    """The prompt of a type around a text; an unknown type is an error."""
    if prompt_type not in TEMPLATES:
        raise ValueError(f"unknown prompt type {prompt_type}")
    system, template = TEMPLATES[prompt_type]
    message = fill(template, text)
    return message if system is None else chat(system, message)


def rerank(entity: Column, candidates: Column, demonstration: str = "", number: int = 1) -> Column:
    return fill(RERANK[number], F.lit(demonstration), entity, candidates)
