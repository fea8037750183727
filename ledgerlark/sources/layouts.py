"""Layouts of delimited bank exports. Columns are named by heading, or #n where there is no heading row."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Layout:
    """How one export is laid out. perspective card: purchases are printed as positive numbers."""

    id: str
    signature: tuple[str, ...] = ()
    columns: int = 0
    date: str = ""
    formats: tuple[str, ...] = ("%d/%m/%Y",)
    description: tuple[str, ...] = ()
    merchant: str = ""
    amount: str = ""
    money_out: str = ""
    money_in: str = ""
    direction: str = ""
    balance: str = ""
    category: str = ""
    type: str = ""
    fee: str = ""
    perspective: str = "household"
    #: (column, values that stay, reason)
    skip: tuple[tuple[str, tuple[str, ...], str], ...] = field(default=())


DAY, LONG_DAY = "%d/%m/%Y", "%d %b %Y"
POUNDS = ("Currency", ("GBP",), "not in pounds")

# The headings of the exports that banks offer.
LAYOUTS = (
    Layout("monzo", ("Transaction ID", "Date", "Time", "Type", "Name", "Emoji", "Category", "Amount"), date="Date", description=("Name", "Description"), merchant="Name", amount="Amount", category="Category", type="Type"),
    Layout("starling", ("Date", "Counter Party", "Reference", "Type", "Amount (GBP)", "Balance (GBP)", "Spending Category"), date="Date", description=("Counter Party", "Reference"), merchant="Counter Party", amount="Amount (GBP)", balance="Balance (GBP)", category="Spending Category", type="Type"),
    Layout("hsbc", columns=3, date="#0", formats=(DAY, LONG_DAY), description=("#1",), amount="#2"),
    Layout("barclays", ("Number", "Date", "Account", "Amount", "Subcategory", "Memo"), date="Date", description=("Memo",), amount="Amount", type="Subcategory"),
    Layout("lloyds-halifax", ("Transaction Date", "Transaction Type", "Sort Code", "Account Number", "Transaction Description", "Debit Amount", "Credit Amount", "Balance"), date="Transaction Date", description=("Transaction Description",), money_out="Debit Amount", money_in="Credit Amount", balance="Balance", type="Transaction Type"),
    Layout("natwest", ("Date", "Type", "Description", "Value", "Balance", "Account Name", "Account Number"), date="Date", formats=(LONG_DAY, DAY), description=("Description",), amount="Value", balance="Balance", type="Type"),
    Layout("santander", ("Date", "Description", "Money in", "Money out", "Balance"), date="Date", description=("Description",), money_out="Money out", money_in="Money in", balance="Balance"),
    Layout("nationwide", ("Date", "Transaction type", "Description", "Paid out", "Paid in", "Balance"), date="Date", formats=(LONG_DAY, DAY), description=("Description",), money_out="Paid out", money_in="Paid in", balance="Balance", type="Transaction type"),
    Layout("chase", ("Date", "Time", "Transaction Type", "Description", "Amount", "Currency", "Balance"), date="Date", formats=(LONG_DAY, DAY), description=("Description",), amount="Amount", balance="Balance", type="Transaction Type", skip=(POUNDS,)),
    Layout(
        "revolut",
        ("Type", "Product", "Started Date", "Completed Date", "Description", "Amount", "Fee", "Currency", "State", "Balance"),
        date="Completed Date", formats=("%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", DAY), description=("Description",), amount="Amount", fee="Fee", balance="Balance", type="Type",
        skip=(("State", ("COMPLETED",), "not completed (pending, declined or reverted)"), ("Product", ("Current",), "a savings pocket or another product, not this account"), POUNDS),
    ),
    Layout("amex", ("Date", "Description", "Amount", "Extended Details", "Appears On Your Statement As", "Reference", "Category"), date="Date", description=("Description",), amount="Amount", perspective="card", category="Category"),
    Layout("barclaycard", ("Transaction Date", "Posting Date", "Card Number", "Description", "Category", "Amount"), date="Transaction Date", formats=(DAY, LONG_DAY), description=("Description",), amount="Amount", perspective="card", category="Category"),
)
