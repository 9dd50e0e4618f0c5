"""The built-in named formulas."""

# Names, categories and formulas as users know them.
CATALOG = {
    "core": {
        "bmi": "weight / (height ** 2)",
        "bsa_mosteller": "0.007184 * (height ** 0.725) * (weight ** 0.425)",
        "age_years": "(today() - birth_date).days / 365.25",
        "age_from_dob": "(today() - date_of_birth).days / 365.25",
        "profit": "revenue - cost",
        "profit_margin_pct": "(revenue - cost) / revenue * 100",
        "total_price": "price * quantity",
        "discount_amount": "price * discount_rate",
        "net_price": "price - (price * discount_rate)",
    },
    "finance": {
        "roi": "((revenue - cost) / cost) * 100",
        "profit_margin": "((revenue - cost) / revenue) * 100",
        "gross_profit": "revenue - cost_of_goods_sold",
        "net_profit": "revenue - total_expenses",
        "break_even": "fixed_costs / (price - variable_cost)",
        "markup": "((selling_price - cost) / cost) * 100",
        "compound_interest": "principal * ((1 + rate) ** periods)",
        "simple_interest": "principal * rate * time",
        "debt_to_equity": "total_debt / total_equity",
        "current_ratio": "current_assets / current_liabilities",
    },
    "medical": {
        "heart_rate_max": "220 - age",
        "heart_rate_reserve": "heart_rate_max - resting_heart_rate",
        "target_heart_rate_low": "((heart_rate_max - resting_heart_rate) * 0.5) + resting_heart_rate",
        "target_heart_rate_high": "((heart_rate_max - resting_heart_rate) * 0.85) + resting_heart_rate",
        "bmi_category": "if_else(bmi < 18.5, 'underweight', if_else(bmi < 25, 'normal', if_else(bmi < 30, 'overweight', 'obese')))",
        "ideal_body_weight_male": "50 + 0.91 * (height - 152.4)",
        "ideal_body_weight_female": "45.5 + 0.91 * (height - 152.4)",
        "creatinine_clearance": "((140 - age) * weight) / (72 * serum_creatinine)",
        "map": "(systolic + 2 * diastolic) / 3",
        "pulse_pressure": "systolic - diastolic",
        "bsa_dubois": "0.007184 * (height ** 0.725) * (weight ** 0.425)",
        "bsa_haycock": "0.024265 * (height ** 0.3964) * (weight ** 0.5378)",
        "bmr_male": "10 * weight + 6.25 * height - 5 * age + 5",
        "bmr_female": "10 * weight + 6.25 * height - 5 * age - 161",
        "waist_to_hip_ratio": "waist_circumference / hip_circumference",
    },
    "physics": {
        "velocity": "distance / time",
        "acceleration": "(final_velocity - initial_velocity) / time",
        "force": "mass * acceleration",
        "kinetic_energy": "0.5 * mass * (velocity ** 2)",
        "potential_energy": "mass * 9.81 * height",
        "work": "force * distance",
        "momentum": "mass * velocity",
        "pressure": "force / area",
        "density": "mass / volume",
        "frequency": "1 / period",
        "wavelength": "speed / frequency",
    },
    "chemistry": {
        "molarity": "moles / volume_liters",
        "moles_from_mass": "mass / molar_mass",
        "mass_from_moles": "moles * molar_mass",
        "dilution_concentration": "initial_concentration * initial_volume / final_volume",
        "percent_yield": "(actual_yield / theoretical_yield) * 100",
        "percent_composition": "(element_mass / compound_mass) * 100",
        "ideal_gas_pressure": "moles * 8.314 * temperature / volume",
        "ideal_gas_volume": "moles * 8.314 * temperature / pressure",
    },
    "engineering": {
        "power_electrical": "voltage * current",
        "resistance": "voltage / current",
        "current": "voltage / resistance",
        "efficiency_pct": "(output_power / input_power) * 100",
        "stress": "force / area",
        "strain": "change_in_length / original_length",
        "youngs_modulus": "stress / strain",
        "flow_rate_volume": "area * velocity",
        "reynolds_number": "density * velocity * diameter / viscosity",
        "capacitance": "charge / voltage",
    },
    "statistics": {
        "z_score": "(value - mean) / std_dev",
        "coefficient_of_variation": "(std_dev / mean) * 100",
        "standard_error": "std_dev / (count ** 0.5)",
        "percent_error": "((actual - expected) / expected) * 100",
        "relative_error_pct": "((actual - predicted) / actual) * 100",
        "slope": "covariance / variance_x",
        "intercept": "mean_y - slope * mean_x",
        "predicted_value": "intercept + slope * x",
        "residual": "actual - predicted",
        "r_squared": "correlation ** 2",
    },
}
